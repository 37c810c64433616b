"""Linear models by stratum with a global fallback, of one label or several, with conformal intervals: all parts fitted in one pass."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .inference import least_squares
from .ranking import MANY, _same
from .resample import _ranked, conformal, draw

#: People, rows to fit to, rows to calibrate on and people to fit to that an interval takes at least.
ENOUGH = (4, 10, 5, 2)


def settled(table: DataFrame) -> tuple[DataFrame, bool]:
    """A table of a row a group and whether it has MANY rows at most: then it has passed through the driver, else it is kept in memory."""
    held = table.limit(MANY + 1).collect()
    if len(held) <= MANY:
        return table.sparkSession.createDataFrame(held, table.schema), True
    return table.persist(), False


def products(x: list[Column], y: list[Column]) -> list[Column]:
    """Products whose sums a least squares fit of each y on all x takes: one, x by x, x by y."""
    x = [F.lit(1.0), *x]
    return [x[i] * x[j] for i in range(len(x)) for j in range(i, len(x))] + [a * b for b in y for a in x]


def solved(sums: Column, n_x: int, n_y: int, alpha: float) -> Column:
    """array<array<double>>: the ridge of each y, intercept first, from an array of the sums of products(); null from null sums.

    One row is one fit: a table of a row a group is solved where its rows lie. Without a penalty, collinear features
    get the solution of least length.
    """
    size = n_x + 1
    upper = np.triu_indices(size)

    def fit(flat) -> list[list[float]] | None:
        if flat is None or not flat[0]:
            return None
        m = np.zeros((size + 1, size + 1))
        m[upper] = flat[: len(upper[0])]
        m[:size, :size] = m[:size, :size] + np.triu(m[:size, :size], 1).T
        out = []
        for k in range(n_y):
            m[:size, size] = m[size, :size] = flat[len(upper[0]) + k * size :][:size]
            out.append((least_squares(m, alpha) if alpha else np.linalg.lstsq(m[:size, :size], m[:size, size], rcond=None)[0]).tolist())
        return out

    return F.pandas_udf(lambda s: pd.Series([fit(v) for v in s], dtype=object), "array<array<double>>")(sums)


def line(coefficients: Column, features: list[str]) -> Column:
    """The prediction by an array of coefficients, the intercept first; null where a feature is."""
    return sum((F.get(coefficients, F.lit(k + 1)) * F.col(f"`{f}`").cast("double") for k, f in enumerate(features)), F.get(coefficients, F.lit(0)))


@dataclass(frozen=True)
class StratumModels:
    """Fitted parts: (_global, _k, n, people, _b, _q) of each stratum with enough rows and people, and of all rows together."""

    parts: DataFrame
    few: bool
    features: list[str]
    labels: list[str]
    stratum: str

    def _joined(self, frame: DataFrame) -> DataFrame:
        own = self.parts.filter(~F.col("_global")).select("_k", F.col("_b").alias("_own_b"), F.col("_q").alias("_own_q"))
        whole = self.parts.filter("_global").select(F.col("_b").alias("_all_b"), F.col("_q").alias("_all_q"))
        key = F.col(self.stratum).cast("string")
        both = frame.join(F.broadcast(own) if self.few else own, key == F.col("_k"), "left").crossJoin(F.broadcast(whole))  # one row
        mine = F.col("_own_b").isNotNull()
        return both.withColumns({"route": F.when(mine, F.col("_k")).otherwise("GLOBAL"), "_b": F.coalesce("_own_b", "_all_b"), "_q": F.when(mine, F.col("_own_q")).otherwise(F.col("_all_q"))}).drop("_k", "_own_b", "_own_q", "_all_b", "_all_q")

    def predict(self, frame: DataFrame, strict: bool = False) -> DataFrame:
        """frame with `route`, its stratum or GLOBAL, and `prediction`, `low`, `high`, of several labels with `_<label>` behind.

        Every row of frame stays; a null among its features gives nulls, or is an error if strict. Bounds are null unless
        all parts that frame's rows take have an interval.
        """
        out = self._joined(frame)
        every = self._joined(frame.select(self.stratum)).agg(F.coalesce(F.min(F.col("_q").isNotNull()), F.lit(False)).alias("_every"))
        out = out.crossJoin(F.broadcast(every))  # one row
        for k, label in enumerate(self.labels):
            tail = f"_{label}" if len(self.labels) > 1 else ""
            value = line(F.get("_b", F.lit(k)), self.features)
            value = F.when(value.isNull(), F.raise_error(F.lit("a row has no prediction"))).otherwise(value) if strict else value
            reach = F.when(F.col("_every"), F.get("_q", F.lit(k)))
            out = out.withColumn(f"prediction{tail}", value).withColumns({f"low{tail}": F.col(f"prediction{tail}") - reach, f"high{tail}": F.col(f"prediction{tail}") + reach})
        return out.drop("_b", "_q", "_every")


def _flagged(rows: DataFrame, share: float, seed: int) -> DataFrame:
    """rows with `_own` and `_all`: whether their person is held out among the people of the stratum, and among all; ceil(share) of them, by hash."""
    order = [draw(F.lit(seed), F.col("_p")), F.col("_p")]
    held = lambda people, *by: _ranked(people.distinct(), order, *by)
    first = lambda frame: F.col("_rank") <= F.ceil(F.col("_all") * F.lit(share))
    own = held(rows.filter(F.col("_k").isNotNull()).select("_k", "_p"), "_k")
    own = own.select("_k", "_p", first(own).alias("_own"))
    whole = held(rows.select("_p"))
    whole = whole.select("_p", first(whole).alias("_in_all"), F.col("_all").alias("_people"))
    out = rows.join(whole, "_p").join(own, ["_k", "_p"], "left")
    return out.withColumn("_own", F.coalesce("_own", F.lit(False))).withColumnRenamed("_in_all", "_all")


def stratum_models(train: DataFrame, features: list[str], labels: list[str], stratum: str, person: str, alpha: float = 1.0, least_rows: int = 10, least_people: int = 2, miscoverage: float | None = None, share: float = 0.2, seed: int = 42) -> StratumModels:
    """Ridges of the labels on the features for each stratum with enough rows and people, and for all rows.

    One aggregate by stratum fits every part, the global one from the sums over strata. With a miscoverage, a share of
    each part's people is held out from its fit, and the errors on them give the part's conformal width; a part with too
    few people or rows for that (ENOUGH) is fitted to all its rows and has no width. Rows without person, or with a null
    among features and labels, go; rows of a null stratum count for the global part alone. No rows are an error.
    """
    x, y = [f"_x{k}" for k in range(len(features))], [f"_y{k}" for k in range(len(labels))]
    values = [F.col(f"`{c}`").cast("double").alias(n) for c, n in zip([*features, *labels], [*x, *y], strict=True)]
    rows = train.select(F.col(stratum).cast("string").alias("_k"), F.col(person).alias("_p"), *values).dropna(subset=["_p", *x, *y])
    kept = []  # while the parts are fitted
    if miscoverage is None:
        rows = rows.withColumns({"_own": F.lit(False), "_all": F.lit(False), "_people": F.lit(None).cast("bigint")})
    else:
        kept = [rows.persist(), (rows := _flagged(rows, share, seed)).persist()]
    terms = products([F.col(c) for c in x], [F.col(c) for c in y])
    sums = [f"_s{k}" for k in range(len(terms))]
    counts = [F.count("*").alias("_n"), F.count_distinct("_p").alias("_g"), F.max("_people").alias("_people")]
    grams = rows.groupBy("_k", "_own", "_all").agg(*counts, *[F.sum(t).alias(s) for t, s in zip(terms, sums, strict=True)])
    routes = F.inline(F.array(F.struct(F.lit(False).alias("_global"), F.col("_k").alias("_to"), F.col("_own").alias("_held")), F.struct(F.lit(True).alias("_global"), F.lit(None).cast("string").alias("_to"), F.col("_all").alias("_held"))))
    each = grams.select("_n", "_g", "_people", *sums, routes).filter(F.col("_global") | F.col("_to").isNotNull())
    fit = lambda c: F.sum(F.when(~F.col("_held"), F.col(c)))
    table = each.groupBy("_global", F.col("_to").alias("_k")).agg(
        F.sum("_n").alias("n"), F.when(F.col("_global"), F.max("_people")).otherwise(F.sum("_g")).alias("people"), F.coalesce(fit("_n"), F.lit(0)).alias("_fit"),
        F.when(F.col("_global"), F.max("_people") - F.ceil(F.max("_people") * F.lit(share))).otherwise(F.coalesce(fit("_g"), F.lit(0))).alias("_fit_people"),
        F.array(*[fit(s) for s in sums]).alias("_part"), F.array(*[F.sum(s) for s in sums]).alias("_whole"),
    )
    table = table.filter(F.col("_global") | ((F.col("n") >= least_rows) & (F.col("people") >= least_people)))
    people, to_fit, to_hold, fit_people = ENOUGH
    ready = F.lit(False) if miscoverage is None else (F.col("people") >= people) & (F.col("_fit") >= to_fit) & (F.col("n") - F.col("_fit") >= to_hold) & (F.col("_fit_people") >= fit_people)
    table = table.withColumn("_ready", ready).withColumn("_b", solved(F.when(F.col("_ready"), F.col("_part")).otherwise(F.col("_whole")), len(x), len(y), alpha))
    parts, few = settled(table.select("_global", "_k", "n", "people", "_ready", "_b"))
    if not parts.filter("_global").count():
        for frame in kept:
            frame.unpersist()
        raise ValueError("no row has a person, every feature and every label")
    if miscoverage is None:
        return StratumModels(parts.withColumn("_q", F.lit(None).cast("array<double>")), few, list(features), list(labels), stratum)
    held = rows.select(*x, *y, routes).filter(F.col("_held") & (F.col("_global") | F.col("_to").isNotNull())).withColumnRenamed("_to", "_k")
    both = _same(held, parts.filter("_ready").select("_global", "_k", "_b"), ["_global", "_k"], few=few)
    errors = F.inline(F.array(*[F.struct(F.lit(k).alias("_label"), (line(F.get("_b", F.lit(k)), x) - F.col(c)).alias("_error")) for k, c in enumerate(y)]))
    widths = conformal(both.select("_global", "_k", errors), "_error", miscoverage, False, "_global", "_k", "_label")
    widths = widths.groupBy("_global", "_k").agg(F.transform(F.array_sort(F.collect_list(F.struct("_label", "q"))), lambda s: s["q"]).alias("_q"))
    parts, few = settled(_same(parts, widths, ["_global", "_k"], "left", few=few))
    for frame in kept:
        frame.unpersist()
    return StratumModels(parts, few, list(features), list(labels), stratum)


def target_groups_models(train: DataFrame, features: list[str], groups: dict[str, list[str]], alpha: float = 1.0) -> DataFrame:
    """(target_group, n, labels, coefficients) of each group of labels, fitted to the rows that have all its labels and every feature.

    All groups come from one pass: a row goes to each group it is complete for, and one matrix of sums serves all labels of
    a group. A group no row is complete for has n 0 and null coefficients. A group of no labels is an error.
    """
    if not groups or not all(groups.values()):
        raise ValueError("every target group needs a label")
    most = max(map(len, groups.values()))
    number = lambda c: F.col(f"`{c}`").cast("double")
    whole = lambda cols: F.forall(F.array(*[number(c) for c in cols]), lambda v: v.isNotNull() & ~F.isnan(v))
    own = [F.when(whole(labels), F.struct(F.lit(name).alias("target_group"), F.array(*[number(c) for c in labels], *[F.lit(0.0)] * (most - len(labels))).alias("_y"))) for name, labels in groups.items()]
    rows = train.filter(whole(features)).select(F.array(*[number(f) for f in features]).alias("_x"), F.explode(F.array_compact(F.array(*own))).alias("_to")).select("_x", "_to.*")
    terms = products([F.get("_x", F.lit(k)) for k in range(len(features))], [F.get("_y", F.lit(k)) for k in range(most)])
    sums = rows.groupBy("target_group").agg(F.count("*").alias("n"), F.array(*[F.sum(t) for t in terms]).alias("_sums"))
    fits = sums.select("target_group", "n", solved(F.col("_sums"), len(features), most, alpha).alias("_b"))
    listed = train.sparkSession.createDataFrame([(g, labels) for g, labels in groups.items()], "target_group string, labels array<string>")
    both = listed.join(fits, "target_group", "left")
    return both.select("target_group", F.coalesce("n", F.lit(0)).alias("n"), "labels", F.slice("_b", F.lit(1), F.size("labels")).alias("coefficients"))


def predict_groups(frame: DataFrame, features: list[str], models: DataFrame) -> DataFrame:
    """frame with `prediction_<group>_<label>` of target_groups_models(), whose rows, a row a group, come to the driver; null where a feature is."""
    for r in models.orderBy("target_group").collect():
        for k, label in enumerate(r.labels):
            value = line(F.array(*[F.lit(c) for c in r.coefficients[k]]), features) if r.coefficients else F.lit(None).cast("double")
            frame = frame.withColumn(f"prediction_{r.target_group}_{label}", value)
    return frame
