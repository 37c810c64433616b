"""Two-group tests, adjusted effects with robust errors, corrections for many tests, and the distributions they need."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .features import common_support
from .ranking import MANY, _same, cumulative, few_groups


def welch(frame: DataFrame, outcome: str, group: str, *by: str) -> DataFrame:
    """(by, n1, n0, t, df) of Welch's test of group 1 against 0; null unless both have two rows."""
    pick = lambda g: F.when(F.col(group) == g, F.col(outcome))
    a = frame.groupBy(*by).agg(*[f(pick(g)).alias(f"{n}{g}") for g in (1, 0) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    s1, s0 = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
    t = (F.col("m1") - F.col("m0")) / F.nullif(F.sqrt(s1 + s0), F.lit(0.0))
    df = (s1 + s0) * (s1 + s0) / F.nullif(s1 * s1 / (F.col("n1") - 1) + s0 * s0 / (F.col("n0") - 1), F.lit(0.0))
    both = (F.col("n1") > 1) & (F.col("n0") > 1)
    return a.select(*by, "n1", "n0", F.col("m1").alias("mean1"), F.col("m0").alias("mean0"), F.when(both, t).alias("t"), F.when(both, df).alias("df"))


def mann_whitney(frame: DataFrame, outcome: str, group: str, *by: str) -> DataFrame:
    """(by, u, z) of group 1 against 0 from average ranks; z with tie and continuity correction."""
    rows = frame.filter(F.col(outcome).isNotNull() & F.col(group).isin(0, 1))
    each = rows.groupBy(*by, outcome).agg(F.count("*").alias("ties"), F.sum(group).alias("ones"))
    both = cumulative(each, outcome, ["ties", "ones"], *by, few=few_groups(rows, *by)).withColumn("rank", F.col("before_ties") + (F.col("ties") + 1) / 2)
    n, n1 = F.sum("ties").cast("double"), F.sum("ones").cast("double")
    a = both.groupBy(*by).agg(n.alias("n"), n1.alias("n1"), F.sum(F.col("rank") * F.col("ones")).alias("r1"), F.sum(F.pow(F.col("ties").cast("double"), F.lit(3)) - F.col("ties")).alias("tied"))
    n, n1 = F.col("n"), F.col("n1")
    n0 = n - n1
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n0 / 12 * ((n + 1) - F.col("tied") / (n * (n - 1))))
    top = F.greatest(u, n1 * n0 - u)
    return a.select(*by, u.alias("u"), ((top - n1 * n0 / 2 - 0.5) / F.nullif(sd, F.lit(0.0))).alias("z"))


def benjamini_hochberg(frame: DataFrame, p: str, key: str) -> DataFrame:
    """frame (a table of tests) with q: the least p * m / rank over higher ranks, 1 at most; null p stay null."""
    known = frame.filter(F.col(p).isNotNull())
    order = Window.orderBy(p, key)
    q = F.col(p) * F.count("*").over(Window.partitionBy()) / F.row_number().over(order)
    known = known.withColumn("_q", q).withColumn("q", F.least(F.lit(1.0), F.min("_q").over(order.rowsBetween(0, Window.unboundedFollowing)))).drop("_q")
    return known.unionByName(frame.filter(F.col(p).isNull()).withColumn("q", F.lit(None).cast("double")))


def holm(frame: DataFrame, p: str, key: str) -> DataFrame:
    """frame (a table of tests) with holm: the running maximum of (m - rank + 1) * p, 1 at most."""
    order = Window.orderBy(p, key)
    known = frame.filter(F.col(p).isNotNull())
    h = (F.count("*").over(Window.partitionBy()) - F.row_number().over(order) + 1) * F.col(p)
    return known.withColumn("_h", h).withColumn("holm", F.least(F.lit(1.0), F.max("_h").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("_h")


def beta_tail(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    total = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or 1e-300)
            c = 1 + step / c or 1e-300
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def t_two_sided(t: float, df: float) -> float:
    return beta_tail(df / 2, 0.5, df / (df + t * t))


def f_tail(f: float, d1: float, d2: float) -> float:
    return beta_tail(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def t_quantile(p: float, df: float) -> float:
    """The value that |t| exceeds with probability p, by bisection."""
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_two_sided(mid, df) > p else (lo, mid)
    return hi


def mann_whitney_exact(u: float, n1: int, n0: int) -> float:
    """The two-sided p of U without ties, from the number of orders of both samples that give each U."""
    if not n1 or not n0:
        return 1.0
    few, many = sorted((int(n1), int(n0)))
    ways = np.zeros(few * many + 1)
    ways[0] = 1
    for k in range(1, few + 1):  # times (1 - q^(many + k)) / (1 - q^k), as shares of all orders
        ways[many + k :] -= ways[: -(many + k)].copy()
        for r in range(k):
            ways[r::k] = np.cumsum(ways[r::k])
        ways *= k / (many + k)
    return float(min(1.0, 2 * ways[math.ceil(max(u, n1 * n0 - u)) :].sum()))


def gram(frame: DataFrame, columns: list[str], *by: str) -> dict[tuple, np.ndarray]:
    """X'X of the columns (few) and a leading one, by key: one aggregate, p x p sums to the driver; over MANY keys are an error."""
    names = ["_1", *columns]
    own = frame.withColumn("_1", F.lit(1.0)).dropna(subset=columns)
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    rows = own.groupBy(*by).agg(*[F.sum(F.col(names[i]).cast("double") * F.col(names[j])).alias(f"s{k}") for k, (i, j) in enumerate(pairs)]).limit(MANY + 1).collect()
    if len(rows) > MANY:
        raise ValueError(f"there are over {MANY} groups, whose sums are too many for the driver")
    out = {}
    for r in rows:
        m = np.zeros((len(names), len(names)))
        for k, (i, j) in enumerate(pairs):
            m[i, j] = m[j, i] = r[f"s{k}"] if r[f"s{k}"] is not None else 0.0
        out[tuple(r[b] for b in by)] = m
    return out


def least_squares(m: np.ndarray, alpha: float = 0.0) -> np.ndarray:
    """Coefficients (intercept first) of the last column of a gram matrix on the others; alpha is a ridge on all but the intercept."""
    if alpha == 0:
        return np.linalg.solve(m[:-1, :-1], m[:-1, -1])
    n, mean = m[0, 0], m[0] / m[0, 0]
    c = m - n * np.outer(mean, mean)
    w = np.linalg.solve(c[1:-1, 1:-1] + alpha * np.eye(len(c) - 2), c[1:-1, -1])
    return np.concatenate([[mean[-1] - mean[1:-1] @ w], w])


def linear_effects(frame: DataFrame, outcome: str, terms: list[str], reference: str = "t", joint: list[str] | None = None, by: tuple[str, ...] = (), strict: bool = True) -> DataFrame:
    """(by, term, n, estimate, se, stat, p, low, high) of least squares with HC3 errors, by two aggregates over the rows, for all groups at once.

    p and the 95 % interval are by the t (or normal) reference; with `joint`, a row `joint` has the robust F test of
    those terms. Rows with a null in a column go. Terms that are collinear or too many for a group's rows are an error,
    or, if not strict, leave the group out. Groups are few: their sums of products come to the driver.
    """
    spark: SparkSession = frame.sparkSession
    rows, k, keys = frame.dropna(subset=[outcome, *terms]), len(terms) + 1, list(by)
    fits = {}
    for key, m in gram(rows, [*terms, outcome], *by).items():
        if m[0, 0] > k and np.linalg.matrix_rank(m[:-1, :-1]) == k:
            fits[key] = m[0, 0], np.linalg.inv(m[:-1, :-1]), least_squares(m)
        elif strict:
            raise ValueError("the terms are collinear or too many for the rows")
    kinds = [f"{c} {frame.schema[c].dataType.simpleString()}" for c in keys]
    head = "".join(f"{x}, " for x in kinds)
    schema = f"{head}term string, n long, estimate double, se double, stat double, p double, low double, high double"
    if not fits:
        return spark.createDataFrame([], schema)
    small = spark.createDataFrame([(*key, b.tolist(), inverse.ravel().tolist()) for key, (_, inverse, b) in fits.items()], f"{head}_b array<double>, _inverse array<double>")
    both = _same(rows, F.broadcast(small), keys)  # a row a group
    x = [F.lit(1.0), *[F.col(t).cast("double") for t in terms]]
    fit = sum((x[i] * F.get("_b", F.lit(i)) for i in range(1, k)), F.get("_b", F.lit(0)))
    h = sum((x[i] * x[j] * F.get("_inverse", F.lit(i * k + j)) * (1 if i == j else 2) for i in range(k) for j in range(i, k)), F.lit(0.0))
    own = both.select(*keys, *[c.alias(f"x{i}") for i, c in enumerate(x)], F.pow((F.col(outcome) - fit) / (1 - h), F.lit(2)).alias("w"))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = own.groupBy(*keys).agg(*[F.sum(F.col(f"x{i}") * F.col(f"x{j}") * F.col("w")).alias(f"s{i}_{j}") for i, j in pairs]).collect()
    out = []
    for r in sums:
        key = tuple(r[c] for c in keys)
        n, inverse, b = fits[key]
        meat = np.zeros((k, k))
        for i, j in pairs:
            meat[i, j] = meat[j, i] = r[f"s{i}_{j}"]
        cov = inverse @ meat @ inverse
        se = np.sqrt(np.diag(cov))
        reach = 1.959963984540054 if reference == "normal" else t_quantile(0.05, n - k)
        tail = normal_two_sided if reference == "normal" else lambda s, d=n - k: t_two_sided(s, d)
        out += [(*key, t, int(n), float(b[i]), float(se[i]), float(b[i] / se[i]), float(tail(b[i] / se[i])), float(b[i] - reach * se[i]), float(b[i] + reach * se[i])) for i, t in enumerate(["intercept", *terms])]
        if joint:
            at = [terms.index(t) + 1 for t in joint]
            f = float(b[at] @ np.linalg.solve(cov[np.ix_(at, at)], b[at]) / len(at))
            out.append((*key, "joint", int(n), None, None, f, float(f_tail(f, len(at), float(n - k))), None, None))
    return spark.createDataFrame(out, schema)


def support_effects(frame: DataFrame, outcome: str, terms: list[str], value: str, group: str, reference: str = "t") -> DataFrame:
    """linear_effects() over the rows whose value lies in the range that all groups share."""
    return linear_effects(common_support(frame.dropna(subset=[outcome, *terms]), value, group), outcome, terms, reference)
