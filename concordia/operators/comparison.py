"""Two groups compared over many measures: one row a measure, with plain and adjusted tests and a correction for their number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .inference import benjamini_hochberg, linear_effects, mann_whitney, mann_whitney_exact, normal_two_sided, t_two_sided, welch
from .ranking import with_median

#: Rows that an adjusted comparison needs, and the size of a sample up to which ranks without ties are tested exactly.
LEAST, EXACT = 10, 8


def long_form(frame: DataFrame, group: str, measures: dict[str, str], covariates: list[str]) -> DataFrame:
    """(measure, group, value, covariates) of each row and measure that frame has a column for; rows without group or value go."""
    each = F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"`{c}`").cast("double").alias("value")) for m, c in measures.items()]))
    return frame.select(F.col(group).cast("int").alias("group"), *covariates, each).filter(F.col("group").isin(0, 1) & F.col("value").isNotNull())


def descriptives(long: DataFrame) -> DataFrame:
    """(measure, n1, n0, mean1, mean0, median1, median0)."""
    pick = lambda g, c: F.when(F.col("group") == g, c)
    each = with_median(long, F.col("value"), "median", "measure", "group", extra=(F.count("value").alias("n"), F.avg("value").alias("mean")))
    one = lambda name, g: F.max(pick(g, F.col(name))).alias(f"{name}{g}")
    return each.groupBy("measure").agg(*[F.coalesce(one("n", g), F.lit(0)).alias(f"n{g}") for g in (1, 0)], *[one(name, g) for name in ("mean", "median") for g in (1, 0)])


def tests(long: DataFrame) -> DataFrame:
    """(measure, t, df, welch_p, u, z, mann_whitney_p): p are worked out on the driver, from one row a measure."""
    ties = long.groupBy("measure", "value").count().groupBy("measure").agg(F.max("count").alias("ties"))
    rows = welch(long, "value", "group", "measure").join(mann_whitney(long, "value", "group", "measure"), "measure").join(ties, "measure").collect()

    def ranks_p(r) -> float | None:
        if not r.n1 or not r.n0 or r.u is None:
            return None
        if min(r.n1, r.n0) <= EXACT and r.ties == 1:
            return mann_whitney_exact(r.u, r.n1, r.n0)
        return min(1.0, normal_two_sided(max(r.z, 0.0))) if r.z is not None else 1.0

    out = [(r.measure, r.t, r.df, t_two_sided(r.t, r.df) if r.t is not None else None, r.u, r.z, ranks_p(r)) for r in rows]
    return long.sparkSession.createDataFrame(out, "measure string, t double, df double, welch_p double, u double, z double, mann_whitney_p double")


def adjusted(long: DataFrame, covariates: list[str]) -> DataFrame:
    """(measure, effect, se, adjusted_p, adjusted_n) of group 1 against 0 by least squares with HC3 errors and a normal reference.

    Measures with under LEAST rows or one group only, and those whose terms are collinear, have none; without covariates there are none.
    """
    if not covariates:
        return long.sparkSession.createDataFrame([], "measure string, effect double, se double, adjusted_p double, adjusted_n long")
    enough = long.groupBy("measure").agg(F.count("*").alias("n"), F.count_distinct("group").alias("g")).filter(f"n >= {LEAST} AND g = 2")
    rows = long.filter(F.col("measure").isin([r.measure for r in enough.collect()]))  # few: a join by measure would send all its rows to one task
    fits = linear_effects(rows, "value", ["group", *covariates], "normal", by=("measure",), strict=False).filter("term = 'group'")
    return fits.select("measure", F.col("estimate").alias("effect"), "se", F.col("p").alias("adjusted_p"), F.col("n").alias("adjusted_n"))


def comparison_table(frame: DataFrame, group: str, expected: list[tuple[str, str, str]], covariates: list[str]) -> DataFrame:
    """A row for each expected (test, measure, column): descriptives, tests, adjusted effect, its q by Benjamini and Hochberg, status.

    Measures whose column frame lacks have the status `column not found` and nulls. Covariates are number columns of
    frame; those of categories are its level columns. The rows of the result are few, those of frame needn't be.
    """
    spark = frame.sparkSession
    found = {f"{t}.{m}": c for t, m, c in expected if c in frame.columns}
    listed = spark.createDataFrame([(f"{t}.{m}", t, m, c, "ok" if c in frame.columns else "column not found") for t, m, c in expected], "key string, test string, name string, column string, status string")
    if not found:
        return listed.drop("key").withColumnRenamed("name", "measure")
    long = long_form(frame, group, found, [c for c in covariates if c in frame.columns])
    all_ = descriptives(long).join(tests(long), "measure", "left").join(adjusted(long, [c for c in covariates if c in frame.columns]), "measure", "left")
    all_ = benjamini_hochberg(all_, "adjusted_p", "measure").withColumnRenamed("measure", "key")
    return listed.join(all_, "key", "left").drop("key").withColumnRenamed("name", "measure")


def group_counts(frame: DataFrame, group: str) -> DataFrame:
    """(group, n) of all rows, nulls left out."""
    return frame.filter(F.col(group).isNotNull()).groupBy(F.col(group).alias("group")).agg(F.count("*").alias("n"))


def stratum_means(train: DataFrame, rows: DataFrame, y: str, keys: list[str], least: int = 5) -> DataFrame:
    """rows with `prediction`, the mean of training rows with the same keys, or, where those are under `least`, with all but the last key, and so on."""
    out, guesses = rows, []
    for k in range(len(keys), -1, -1):
        means = train.filter(F.col(y).isNotNull()).groupBy(*keys[:k]).agg(F.avg(y).alias(f"_m{k}"), F.count(y).alias(f"_n{k}"))
        out = out.join(means, keys[:k], "left") if k else out.crossJoin(F.broadcast(means))  # one row
        guesses.append(F.when(F.col(f"_n{k}") >= least, F.col(f"_m{k}")))
    mean: Column = F.coalesce(*guesses, F.col("_m0"))
    return out.withColumn("prediction", mean).drop(*[f"_{x}{k}" for x in "mn" for k in range(len(keys) + 1)])
