"""Ranks, medians and order statistics of groups of any size: sketches say where to look, counts give the exact answer.

No group is ever sorted in one task. A wanted rank is bracketed by a quantile sketch, and only the values within the
bracket are counted one by one; ranks of all values come from ranges that a sketch of the group's own values parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ranges into which a group's different values are parted, a power of two, and the accuracy of the sketch that parts them.
RANGES, PARTING = 128, 2560
#: Groups of up to so many rows are counted whole. Of larger ones the sketch, whose ranks are right to 1 / ACCURACY of the
#: rows, brackets a wanted rank by REACH of the rows on either side.
SMALL, REACH, ACCURACY = 2000, 0.004, 2000
#: Groups up to which a table of a row a group is broadcast, or passes through the driver, and values within a group's
#: brackets that one task may sort; more are parted.
MANY, SORTED = 10_000, 1_000_000


def _same(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner", few: bool = False) -> DataFrame:
    """left with right's columns by equal keys, nulls being equal; without keys, right is one row. few: right has MANY rows at most."""
    if not by:
        return left.crossJoin(F.broadcast(right))  # one row
    other = right.withColumnsRenamed({c: f"_of_{c}" for c in by})
    on = [left[c].eqNullSafe(other[f"_of_{c}"]) for c in by]
    return left.join(F.broadcast(other) if few else other, on, how).drop(*[f"_of_{c}" for c in by])


def few_groups(frame: DataFrame, *by: str) -> bool:
    """Whether frame has MANY groups at most: reads the keys alone."""
    return not by or frame.select(*by).distinct().limit(MANY + 1).count() <= MANY


def settled(table: DataFrame) -> DataFrame:
    """table worked out now and broadcast where it is joined, if it has MANY rows at most; a larger one as it is."""
    rows = table.limit(MANY + 1).collect()
    return table if len(rows) > MANY else F.broadcast(table.sparkSession.createDataFrame(rows, table.schema))


def splitters(each: DataFrame, value: str, counts: list[str], *by: str) -> DataFrame:
    """(by, _cuts, all_<count>): values that part each group's different values into RANGES of about as many, however they are spread.

    Values are looked at beside their counts, so that this step needs the columns that cumulative()'s others do: then
    Spark reads one shuffle for all of them.
    """
    v = F.when(sum(map(F.col, counts[1:]), F.col(counts[0])) >= 0, F.col(value).cast("double"))
    cut = F.percentile_approx(v, [k / RANGES for k in range(1, RANGES)], PARTING)
    return each.groupBy(*by).agg(F.array_distinct(cut).alias("_cuts"), *[F.sum(c).alias(f"all_{c}") for c in counts])


def parted(each: DataFrame, table: DataFrame, value: str, *by: str, few: bool = False) -> DataFrame:
    """each with its group's columns of table and `_range`, how many of the group's `_cuts` are less: by bisection, each step from the one before."""
    steps, at, v = [], F.lit(0), F.col(value).cast("double")
    for k in range(RANGES.bit_length() - 2, -1, -1):
        steps.append(F.when(F.get("_cuts", at + (2**k - 1)) < v, at + 2**k).otherwise(at).alias(f"_step{k}" if k else "_range"))
        at = F.col(f"_step{k}")
    return _same(each, table, list(by), few=few).select("*", *steps).drop(*[f"_step{k}" for k in range(1, RANGES.bit_length())])


def cumulative(each: DataFrame, value: str, counts: list[str], *by: str, few: bool | None = None) -> DataFrame:
    """each (by, value, counts), one row a value, with `before_<count>`, the sum over smaller values of the group, and `all_<count>`.

    Splitters part a group's values, a heavy value being one row; sums by range give each range's offset, and only a range
    is sorted in a task. All three steps read the same shuffle of each, if its columns but for by and value are all among
    the counts. few says that there are MANY groups at most; by default that is looked up.
    """
    keys = list(by)
    few = few_groups(each, *by) if few is None else few
    cuts = splitters(each, value, counts, *by)
    sums = parted(each, cuts, value, *by, few=few).groupBy(*keys, "_range").agg(*[F.sum(c).alias(c) for c in counts])
    run = Window.partitionBy(*keys or [F.lit(0)]).orderBy("_range")  # a row a range; every splitter is a value, so no range is empty but the last
    sums = sums.select(*keys, "_range", *[(F.sum(c).over(run) - F.col(c)).alias(c) for c in counts])
    offsets = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_range", *counts))).alias("_offsets"))  # RANGES rows a group
    both = parted(each, _same(offsets, cuts, keys, few=few), value, *by, few=few)
    both = both.withColumns({f"_off_{c}": F.get("_offsets", "_range")[c] for c in counts}).drop("_cuts", "_offsets")
    within = Window.partitionBy(*keys, "_range").orderBy(F.col(value).cast("double")).rowsBetween(Window.unboundedPreceding, -1)
    out = both.withColumns({f"before_{c}": F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"_off_{c}") for c in counts})
    return out.drop("_range", *[f"_off_{c}" for c in counts])


def number(value: Column) -> Column:
    """value as a number, null for NaN."""
    return F.nanvl(value.cast("double"), F.lit(None))


def counted(frame: DataFrame, value: Column, *by: str) -> DataFrame:
    """(by, value, ties) of each distinct value; nulls and NaN are left out."""
    rows = frame.select(*by, number(value).alias("value")).filter(F.col("value").isNotNull())
    return rows.groupBy(*by, "value").agg(F.count("*").alias("ties"))


def order_statistics(each: DataFrame, wanted: dict[str, Column], *by: str) -> DataFrame:
    """(by, n, one column a wanted rank) from counts (by, value, ties); a rank is a column of `n`, from 1."""
    run = cumulative(each, "value", ["ties"], *by).withColumn("n", F.col("all_ties"))
    at = lambda r: (F.col("before_ties") < r) & (F.col("before_ties") + F.col("ties") >= r)
    return run.groupBy(*by).agg(F.first("n").alias("n"), *[F.min(F.when(at(r), F.col("value"))).alias(name) for name, r in wanted.items()])


def selected(frame: DataFrame, value: Column, wanted: dict[str, tuple[float, Column]], *by: str, extra: tuple[Column, ...] = ()) -> DataFrame:
    """(by, extra, _n, one column a wanted rank): exact order statistics of value, with aggregates over the same rows.

    A wanted rank is (share, rank), rank a column of `n`, the group's rows with a value, within three of share * n. The
    first pass takes `extra` and a sketch of each group in one aggregate, which runs at once; the second counts the
    rows below the brackets and, one by one, the values within. Values outside never leave the task that read them.
    Brackets of up to SORTED values are sorted as they are, larger ones by cumulative(). With over MANY groups all values are counted instead. Null and NaN values count as none; a group without any has
    _n 0 and nulls. A rank outside its bracket, which the sketch's accuracy excludes, would be an error.
    """
    keys, rows = list(by), frame.withColumn("_v", number(value))
    shares = sorted({s for s, _ in wanted.values()})
    ends = [x for s in shares for x in (max(0.0, s - REACH), min(1.0, s + REACH))]
    one = rows.groupBy(*keys).agg(*extra, F.count("_v").alias("_n"), F.percentile_approx("_v", ends, ACCURACY).alias("_q"))
    held = one.limit(MANY + 1).collect()
    if len(held) > MANY:
        found = order_statistics(counted(frame, value, *by), {name: r for name, (_, r) in wanted.items()}, *by)
        return _same(one.drop("_q"), found.drop("n"), keys, "left")
    one = frame.sparkSession.createDataFrame(held, one.schema)
    both = _same(rows.select(*keys, "_v"), one.select(*keys, "_n", "_q"), keys, few=True).filter(F.col("_v").isNotNull())
    low, high = ([F.get("_q", F.lit(2 * k + j)) for k in range(len(shares))] for j in (0, 1))
    inside = F.col("_n") <= SMALL
    for a, b in zip(low, high, strict=True):
        inside = inside | ((F.col("_v") >= a) & (F.col("_v") <= b))
    # a row outside counts below the next bracket, at its lower end
    above = [F.when(a > F.col("_v"), a) for a in low]
    up = F.coalesce(F.least(*above) if len(above) > 1 else above[0], F.lit(float("inf")))
    each = both.select(*keys, "_v", inside.alias("_in"), F.when(inside, F.col("_v")).otherwise(up).alias("value"))
    each = each.groupBy(*keys, "value").agg(F.count_if("_in").alias("ties"), F.count_if(~F.col("_in")).alias("out"))
    if max((r["_n"] if r["_n"] <= SMALL else 3 * REACH * len(shares) * r["_n"] for r in held), default=0) <= SORTED:
        run = Window.partitionBy(*keys or [F.lit(0)]).orderBy("value")
        run = each.select(*keys, "value", "ties", (F.sum(F.col("ties") + F.col("out")).over(run) - F.col("ties")).alias("before"), F.sum(F.col("ties") + F.col("out")).over(Window.partitionBy(*keys or [F.lit(0)])).alias("n"))
    else:
        run = cumulative(each, "value", ["ties", "out"], *by, few=True)
        run = run.select(*keys, "value", "ties", (F.col("before_ties") + F.col("before_out") + F.col("out")).alias("before"), (F.col("all_ties") + F.col("all_out")).alias("n"))
    before = F.col("before")
    found = run.groupBy(*keys).agg(*[F.min(F.when((before < r) & (before + F.col("ties") >= r), F.col("value"))).alias(name) for name, (_, r) in wanted.items()])
    out = _same(one.drop("_q"), found, keys, "left", few=True)
    missed = (F.col("_n") > 0) & F.greatest(*[F.col(name).isNull() for name in wanted], F.lit(False))
    return out.withColumns({name: F.when(missed, F.raise_error(F.lit("a rank lies outside its bracket"))).otherwise(F.col(name)) for name in wanted})


def medians(each: DataFrame, *by: str) -> DataFrame:
    """(by, median) from counts (by, value, ties)."""
    n = F.col("n")
    both = order_statistics(each, {"_low": F.floor((n + 1) / 2), "_high": F.ceil((n + 1) / 2)}, *by)
    return both.select(*by, ((F.col("_low") + F.col("_high")) / 2).alias("median"))


def with_median(frame: DataFrame, value: Column, name: str, *by: str, extra: tuple[Column, ...] = ()) -> DataFrame:
    """(by, extra, name): aggregates over frame and the exact median of value in each group, by selected()."""
    n = F.col("n")
    both = selected(frame, value, {"_low": (0.5, F.floor((n + 1) / 2)), "_high": (0.5, F.ceil((n + 1) / 2))}, *by, extra=extra)
    return both.withColumn(name, (F.col("_low") + F.col("_high")) / 2).drop("_low", "_high", "_n")
