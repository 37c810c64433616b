"""Splits, folds and resampling by person: every choice is a hash of seed and person, so any engine repeats it."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .draws import resampled
from .ranking import MANY, _same, selected, settled


def draw(*parts: Column) -> Column:
    """A whole number below 2**32 from the md5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("bigint")


def _ranked(people: DataFrame, order: list[Column], *by: str) -> DataFrame:
    """people with `_rank` from 1 in the order, `_all` people and none in one task: ranks are counted by range of the first key.

    The first key's leading bits part the people into ranges; sums over ranges, a bounded table, give each range's offset.
    """
    parted = people.withColumn("_range", F.shiftright(order[0], 20))
    sizes = parted.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    offsets = sizes.withColumn("_before", F.sum("_n").over(w.orderBy("_range")) - F.col("_n")).withColumn("_all", F.sum("_n").over(w)).drop("_n")
    within = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order))
    return parted.join(offsets, [*by, "_range"]).withColumn("_rank", within + F.col("_before")).drop("_range", "_before")


def _last_held(people: DataFrame, person: str, share: float, seed: int) -> Row | None:
    """(_h, person) of the last of the ceil(share * people) people that are first by hash, None where there is none.

    people holds each person once. Counts by range of the hash, 4,096 rows at most, tell the range in which that person
    lies; the people of that range alone are ranked.
    """
    hashed = people.select(draw(F.lit(seed), F.col(person)).alias("_h"), person).persist()
    at = F.shiftright("_h", 20)
    sizes = sorted(hashed.groupBy(at.alias("_range")).agg(F.count("*").alias("_n")).collect())
    first, last = math.ceil(sum(r._n for r in sizes) * share), None
    for r in sizes:
        if first <= r._n or r is sizes[-1]:
            rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_h", person))
            last = hashed.filter(at == r._range).withColumn("_rank", rank).filter(F.col("_rank") == min(first, r._n)).select("_h", person).first()
            break
        first -= r._n
    hashed.unpersist()
    return last


def split(frame: DataFrame, person: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """frame with `split`: whole people go to test, ceil(share * people) of them, the first by hash.

    The people are looked at at once, to find the last one in test; a row's split then follows from its own person, so
    rows are neither moved nor joined.
    """
    known, kind = frame.filter(F.col(person).isNotNull()), frame.schema[person].dataType
    one = F.col(person) + F.lit(0).cast(kind) if kind.typeName() in ("float", "double") else F.col(person)  # -0.0 is 0.0
    last = _last_held(known.select(one.alias(person)).distinct(), person, share, seed)
    test = F.lit(False)
    if last is not None:
        test = F.struct(draw(F.lit(seed), one), one) <= F.struct(F.lit(last[0]).cast("bigint"), F.lit(last[1]).cast(kind))
    return known.select(person, *[c for c in known.columns if c != person], F.when(test, "test").otherwise("train").alias("split"))


def fold_count(frame: DataFrame, person: str, k: int) -> int:
    """k folds, or as many as there are people, but two at least; an error for k below 2."""
    if k < 2:
        raise ValueError("folds must be two at least")
    return max(2, min(k, frame.select(person).filter(F.col(person).isNotNull()).distinct().limit(k).count()))


def folds(frame: DataFrame, person: str, k: int = 5, seed: int = 42) -> DataFrame:
    """frame with `fold`: people, the largest first, are dealt to folds there and back, so folds differ by little.

    With fewer people than folds there are as many folds as people, two at least.
    """
    k = fold_count(frame, person, k)
    sizes = frame.filter(F.col(person).isNotNull()).groupBy(person).agg(F.count("*").alias("_rows"))
    many = sizes.groupBy("_rows").agg(F.count("*").alias("_people"))
    before = many.withColumn("_larger", F.sum("_people").over(Window.orderBy(F.desc("_rows"))) - F.col("_people")).drop("_people")
    ranked = _ranked(sizes, [draw(F.lit(seed), F.col(person)), F.col(person)], "_rows").join(before, "_rows")
    at = F.col("_larger") + F.col("_rank") - 1
    lap, place = F.floor(at / k), at % k
    dealt = ranked.select(person, F.when(lap % 2 == 0, place).otherwise(k - 1 - place).cast("int").alias("fold"))
    return frame.join(dealt, person)


def shares(loads: list[int], size: int, people: int) -> list[int]:
    """How many of so many people of one size each fold gets, if each in turn goes to the lightest fold, the first of equals."""
    given = lambda level: [max(0, -(-(level - x) // size)) for x in loads]
    low, high = min(loads), max(loads) + size * (people + 1)
    while low < high:  # the highest level to which they fill all folds
        mid = (low + high + 1) // 2
        low, high = (mid, high) if sum(given(mid)) <= people else (low, mid - 1)
    out = given(low)
    for i in [i for i, x in enumerate(loads) if x + out[i] * size == low][: people - sum(out)]:
        out[i] += 1
    return out


def balanced_folds(frame: DataFrame, person: str, k: int = 5, seed: int = 42) -> DataFrame:
    """frame with `fold`: people, the largest first and by hash among equals, each to the fold with the fewest rows so far.

    Only the number of people of each size comes to the driver (sizes are few); which fold gets how many of a size
    follows from that, and people of a size are dealt by their rank. Fewer people than folds make fewer folds, two at least.
    """
    k = fold_count(frame, person, k)
    sizes = frame.filter(F.col(person).isNotNull()).groupBy(person).agg(F.count("*").alias("_rows"))
    loads, dealt = [0] * k, []
    for rows, people in sizes.groupBy("_rows").agg(F.count("*").alias("people")).orderBy(F.desc("_rows")).collect():
        before = 0
        for fold, n in enumerate(shares(loads, rows, people)):
            if n:
                dealt.append((rows, before, before + n, fold))
                before += n
                loads[fold] += n * rows
    table = F.broadcast(frame.sparkSession.createDataFrame(dealt, "_rows long, _from long, _to long, fold int"))  # a row a size and fold
    ranked = _ranked(sizes, [draw(F.lit(seed), F.col(person)), F.col(person)], "_rows")
    each = ranked.join(table, "_rows").filter((F.col("_rank") > F.col("_from")) & (F.col("_rank") <= F.col("_to"))).select(person, "fold")
    return frame.join(each, person)


def repeated_splits(frame: DataFrame, person: str, share: float = 0.2, seeds: range = range(42, 72)) -> DataFrame:
    """(person, seed, split) of every seed at once: whole people go to test, ceil(share * people) of them, the first by hash."""
    people = frame.select(person).filter(F.col(person).isNotNull()).distinct().withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    ranked = _ranked(people, [draw(F.col("seed"), F.col(person)), F.col(person)], "seed")
    return ranked.select(person, "seed", F.when(F.col("_rank") <= F.ceil(F.col("_all") * F.lit(share)), "test").otherwise("train").alias("split"))


def class_folds(frame: DataFrame, person: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """frame with `fold`: within each class people are dealt in turn by hash; a person has the class of its largest label."""
    people = frame.filter(F.col(person).isNotNull()).groupBy(person).agg(F.max(label).alias("_class"))
    ranked = _ranked(people, [draw(F.lit(seed), F.col(person)), F.col(person)], "_class")
    return frame.join(ranked.select(person, ((F.col("_rank") - 1) % k).cast("int").alias("fold")), person)


def mixed_class_folds(frame: DataFrame, person: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """frame with `fold`: whole people, whose rows may be of several classes, so that each class is spread over the folds alike.

    People with the same number of rows of each class are alike. Kinds of people, those with the most uneven rows first,
    are dealt in turn: every fold gets an equal share of a kind, and what is left over goes, one at a time, to the folds
    in which it leaves the shares of the classes least uneven, then to those with fewest rows. Which people of a kind
    go where follows from their hash. Only kinds and how many people are of each come to the driver; where there are
    over MANY, counts of rows that agree in their power of two make one kind. Rows without person go, classes may be null.
    """
    k = fold_count(frame, person, k)
    rows = frame.filter(F.col(person).isNotNull())
    classes = [r[0] for r in rows.select(F.col(label).cast("string")).distinct().sort(label).collect()]  # few
    count = [F.count_if(F.col(label).cast("string").eqNullSafe(F.lit(c))).alias(f"_c{j}") for j, c in enumerate(classes)]
    people = rows.groupBy(person).agg(*count)
    names = [f"_c{j}" for j in range(len(classes))]
    kind = F.array(*names)
    sizes = people.groupBy(kind.alias("_kind")).count().limit(MANY + 1).collect()
    if len(sizes) > MANY:
        kind = F.array(*[F.floor(F.log2(F.col(c) + 1)) for c in names])
        sizes = people.groupBy(kind.alias("_kind")).count().collect()
    means = {tuple(r[0]): list(r[1:]) for r in people.groupBy(kind.alias("_kind")).agg(*[F.avg(c) for c in names]).collect()}
    whole = np.maximum(sum(np.array(means[tuple(r[0])]) * r[1] for r in sizes), 1e-12) if sizes else np.ones(len(classes))
    held, dealt = np.zeros((k, len(classes))), []
    for own, n in sorted(((tuple(r[0]), r[1]) for r in sizes), key=lambda x: (-np.std(means[x[0]]), x[0])):
        mean = np.array(means[own])
        extra = [0] * k
        for _ in range(n % k):
            tried = [(round(float(np.std((held + mean * np.eye(k)[:, [f]]) / whole, axis=0).mean()), 12), held[f].sum(), f) for f in range(k) if not extra[f]]
            best = min(tried)[2]
            extra[best] = 1
            held[best] += mean
        held += mean * (n // k)
        ends = np.append(0, np.cumsum([n // k + x for x in extra]))
        dealt += [(list(own), int(a), int(b), f) for f, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if b > a]
    table = F.broadcast(frame.sparkSession.createDataFrame(dealt, "_kind array<long>, _from long, _to long, fold int"))  # k rows a kind
    ranked = _ranked(people.select(person, kind.cast("array<long>").alias("_kind")), [draw(F.lit(seed), F.col(person)), F.col(person)], "_kind")
    each = ranked.join(table, "_kind").filter((F.col("_rank") > F.col("_from")) & (F.col("_rank") <= F.col("_to"))).select(person, "fold")
    return frame.join(each, person)


def conformal_rank(alpha: float, textbook: bool = False) -> Column:
    """The rank among `n` scores that covers 1 - alpha: the "higher" quantile at ceil((n + 1)(1 - alpha)) / n, 1 at most, or that rank itself."""
    n = F.col("n")
    rank = F.ceil((n + 1) * (1 - F.lit(alpha)))
    return F.least(rank, n) if textbook else F.ceil(F.least(F.lit(1.0), rank / n) * (n - 1)) + 1


def conformal(calibration: DataFrame, residual: str, alpha: float = 0.1, textbook: bool = False, *by: str) -> DataFrame:
    """(by, n, q): the half-width of split-conformal intervals, the "higher" quantile of absolute residuals.

    The level is ceil((n + 1)(1 - alpha)) / n, 1 at most; with `textbook` the order statistic of that rank itself.
    """
    return selected(calibration, F.abs(residual), {"q": (1 - alpha, conformal_rank(alpha, textbook))}, *by).withColumnRenamed("_n", "n").filter("n > 0")


def split_conformal(frame: DataFrame, person: str, fit, y: str, alpha: float = 0.1, share: float = 0.2, seed: int = 42, *by: str):
    """(model, widths): a model fitted to people not held out, and conformal() of its errors on those held out, by group.

    fit(rows) gives a function from rows to rows with `prediction`. Held out are ceil(share * people). Widths are None,
    and the model is fitted to all rows, with under 4 people, 10 rows to fit, 5 to calibrate or 2 people to fit. The rows
    are kept while the model is fitted and errors are ranked, so frame should have no columns that fit doesn't need.
    """
    known = frame.filter(F.col(person).isNotNull() & F.col(y).isNotNull()).persist()
    marked = split(known, person, share, seed)
    n = {r[0]: (r[1], r[2]) for r in marked.groupBy("split").agg(F.count("*"), F.count_distinct(person)).collect()}
    (fit_rows, fit_people), (held_rows, held_people) = n.get("train", (0, 0)), n.get("test", (0, 0))
    if fit_people + held_people < 4 or fit_rows < 10 or held_rows < 5 or fit_people < 2:
        model = fit(known)
        known.unpersist()
        return model, None
    model = fit(marked.filter("split = 'train'").drop("split"))
    held = model(marked.filter("split = 'test'").drop("split"))
    widths = settled(conformal(held.withColumn("_error", F.col("prediction") - F.col(y)), "_error", alpha, False, *by))
    known.unpersist()
    return model, widths


def with_interval(predicted: DataFrame, widths: DataFrame | None, *by: str) -> DataFrame:
    """predicted with `low` and `high`, the prediction less and plus its group's width; null without widths."""
    if widths is None:
        return predicted.withColumn("low", F.lit(None).cast("double")).withColumn("high", F.lit(None).cast("double"))
    both = _same(predicted, widths.select(*by, F.col("q").alias("_q")), list(by), "left")
    return both.withColumns({"low": F.col("prediction") - F.col("_q"), "high": F.col("prediction") + F.col("_q")}).drop("_q")


def local_conformal(calibration: DataFrame, residual: str, scale: str, alpha: float = 0.1, *by: str) -> DataFrame:
    """conformal() of residuals divided by a local scale: a row's half-width is q times its own scale; rows without scale go."""
    return conformal(calibration.filter(F.col(scale) > 0).withColumn("_score", F.col(residual) / F.col(scale)), "_score", alpha, False, *by)


def bootstrap(frame: DataFrame, person: str, y: str, p: str, replicates: int = 200, seed: int = 42) -> DataFrame:
    """(replicate, n, rmse, mae, bias, ccc): metrics of people drawn again with replacement.

    Rows are summed by person once; people's sums are weighed where they lie, and a row a replicate and leaf is shuffled.
    """
    a, b = F.col(y), F.col(p)
    rows = frame.filter(a.isNotNull() & b.isNotNull() & F.col(person).isNotNull())
    e = b - a
    sums = rows.groupBy(person).agg(F.count("*").alias("n"), *[F.sum(x).alias(s) for s, x in (("y", a), ("p", b), ("yy", a * a), ("pp", b * b), ("yp", a * b), ("e", e), ("ae", F.abs(e)), ("ee", e * e))])
    names = ["n", "y", "p", "yy", "pp", "yp", "e", "ae", "ee"]

    def weighed(part: pd.DataFrame, weight: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame(weight @ part[names].to_numpy(np.float64), columns=names).assign(replicate=np.arange(len(weight)))

    each = resampled(sums, person, replicates, seed, weighed, ", ".join(f"{s} double" for s in names) + ", replicate long")
    t = each.groupBy("replicate").agg(*[F.sum(s).alias(s) for s in names]).withColumn("n", F.col("n").cast("bigint"))
    n = F.col("n")
    var = lambda s, q: (F.col(q) - F.col(s) * F.col(s) / n) / (n - 1)
    cov = (F.col("yp") - F.col("y") * F.col("p") / n) / (n - 1)
    ccc = 2 * cov / F.nullif(var("y", "yy") + var("p", "pp") + F.pow(F.col("e") / n, F.lit(2)), F.lit(0.0))
    return t.select("replicate", n, F.sqrt(F.col("ee") / n).alias("rmse"), (F.col("ae") / n).alias("mae"), (F.col("e") / n).alias("bias"), ccc.alias("ccc"))


def replicate_summary(replicates: DataFrame, metrics: list[str], requested: int | None = None) -> DataFrame:
    """(metric, requested, valid, low, median, high): percentile intervals over replicates (a row each), by linear interpolation.

    `requested` is how many replicates there were to be; without it, how many rows there are.
    """
    long = replicates.unpivot([], metrics, "metric", "value")
    valid = F.when(F.col("value").isNotNull() & ~F.isnan("value"), F.col("value"))
    q = lambda at: F.percentile(valid, F.lit(at))
    asked = F.lit(requested).cast("long") if requested is not None else F.count("*")
    return long.groupBy("metric").agg(asked.alias("requested"), F.count(valid).alias("valid"), q(0.025).alias("low"), q(0.5).alias("median"), q(0.975).alias("high"))


def rejection_summary(replicates: DataFrame, reject: str, *by: str) -> DataFrame:
    """(by, replicates, power, mc_se) of any table of replicate decisions."""
    rate = F.avg(F.col(reject).cast("double"))
    return replicates.groupBy(*by).agg(F.count(reject).alias("replicates"), rate.alias("power"), F.sqrt(rate * (1 - rate) / F.count(reject)).alias("mc_se"))


def routes(train: DataFrame, test: DataFrame, stratum: str, person: str, least_rows: int = 10, least_people: int = 2) -> DataFrame:
    """test with `route`: its stratum where training has enough rows and people of it, else GLOBAL."""
    enough = train.groupBy(stratum).agg(F.count("*").alias("_n"), F.count_distinct(person).alias("_g")).filter((F.col("_n") >= least_rows) & (F.col("_g") >= least_people))
    return test.join(enough.select(stratum, F.lit(True).alias("_ok")), stratum, "left").withColumn("route", F.when(F.col("_ok"), F.col(stratum).cast("string")).otherwise("GLOBAL")).drop("_ok")
