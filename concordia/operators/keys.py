"""Joining two sources of one person: key completion, version differences, nearest visits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import base_person, days_between, person


def complete_keys(clinical: DataFrame, digital: DataFrame, key: str) -> DataFrame:
    """clinical with `matched` (exact, completed or unresolved) and its key completed.

    A key without exact counterpart takes the digital key of the same base, if the base has one alone.
    """
    ids = digital.select(person(F.col(key)).alias("_d")).dropna().distinct()
    single = ids.groupBy(base_person(F.col("_d")).alias("_base")).agg(F.count("*").alias("_n"), F.min("_d").alias("_one")).filter("_n = 1").select("_base", "_one")
    own = clinical.withColumn("_key", person(F.col(key))).withColumn("_base", base_person(F.col(key)))
    both = own.join(ids, F.col("_key") == F.col("_d"), "left").join(single, "_base", "left")
    matched = F.when(F.col("_d").isNotNull(), "exact").when(F.col("_one").isNotNull(), "completed").otherwise("unresolved")
    return both.withColumn("matched", matched).withColumn(key, F.coalesce("_d", "_one", "_key")).drop("_key", "_base", "_d", "_one")


def ambiguous(digital: DataFrame, key: str) -> DataFrame:
    """(base, ids) of each base with several keys."""
    return digital.select(person(F.col(key)).alias("_d")).dropna().distinct().groupBy(base_person(F.col("_d")).alias("base")).agg(F.count("*").alias("ids")).filter("ids > 1")


def paired(digital: DataFrame, clinical: DataFrame, key: str, suffix: str = "_clinical") -> DataFrame:
    """Inner join on the key; other clinical columns that clash get the suffix. No row that meets another is an error."""
    clash = {c: c + suffix for c in clinical.columns if c != key and c in digital.columns}
    if digital.select(key).join(clinical.select(key), key, "left_semi").isEmpty():
        raise ValueError(f"no {key} of one source is in the other")
    return digital.join(clinical.withColumnsRenamed(clash), key)


def diff(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(change, variable, n): added, removed and common keys, and changed cells of each column among common keys."""
    a, b = old.select(F.col(key).alias("_k"), F.struct(*columns).alias("_a")), new.select(F.col(key).alias("_k"), F.struct(*columns).alias("_b"))
    both = a.join(b, "_k", "full_outer")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    common = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    one = both.agg(count(F.col("_a").isNull()).alias("added"), count(F.col("_b").isNull()).alias("removed"), count(common).alias("common"), *[count(common & ~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}"))).alias(f"changed_{c}") for c in columns])
    return one.unpivot([], one.columns, "change", "n")


def unresolved(clinical: DataFrame, digital: DataFrame, key: str) -> DataFrame:
    """(key) of each clinical key without a digital one, exact or completed, in order."""
    left = complete_keys(clinical, digital, key).filter((F.col("matched") == "unresolved") & F.col(key).isNotNull())
    return left.select(key).distinct().orderBy(key)


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row (left, right, common): distinct keys of each side and of both."""
    marked = a.select(key).distinct().withColumn("_a", F.lit(1)).join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full_outer").filter(F.col(key).isNotNull())
    return marked.agg(F.count("_a").alias("left"), F.count("_b").alias("right"), F.count(F.col("_a") + F.col("_b")).alias("common"))


def disjoint(a: DataFrame, b: DataFrame, key: str) -> None:
    """An error if both sides share a key."""
    if n := a.select(key).filter(F.col(key).isNotNull()).join(b.select(key), key, "left_semi").distinct().count():
        raise ValueError(f"{n} values of {key} are on both sides")


def exclusions(frame: DataFrame, key: str, steps: dict[str, DataFrame]) -> DataFrame:
    """(key, reason): keys of frame that steps, each a table of the keys left after it, in order, left out, with the first to do so."""
    left, out = frame.select(key).filter(F.col(key).isNotNull()).distinct(), []
    for reason, after in steps.items():
        out.append(left.join(after.select(key), key, "left_anti").withColumn("reason", F.lit(reason)))
        left = left.join(after.select(key), key, "left_semi")
    return reduce(DataFrame.unionByName, out)


def retest(visits: DataFrame, key: str, at: str, value: str, low: float = 14, high: float = 28) -> DataFrame:
    """(key, at, again, change): each visit with the first later one of its key that is `low` to `high` days on, and how much the value rose.

    Each visit asks at the time `low` days on for the next visit. Questions and visits are sorted by stretches of
    `high` days, visits also standing in the stretch before theirs, and the answer is carried along: no pairs are made,
    and no key is one group. Of several visits at one time that of the smallest value answers.
    """
    time, span = F.unix_micros(F.col(at).cast("timestamp")), int(high * 86_400_000_000)
    own = visits.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, at, F.col(value).alias("_v"), time.alias("_t"))
    asked = own.select(key, at, "_v", (F.col("_t") + int(low * 86_400_000_000)).alias("_q"), F.lit(0).alias("_side"))
    asked = asked.withColumn("_part", F.floor(F.col("_q") / span))
    part = F.floor(F.col("_t") / span)
    seen = own.select(key, F.struct(F.col("_t"), F.col(at).alias("again"), F.col("_v").alias("_w")).alias("_n"), F.col("_t").alias("_q"), F.lit(1).alias("_side"), F.explode(F.array(part - 1, part)).alias("_part"))
    both = asked.unionByName(seen, allowMissingColumns=True)
    run = Window.partitionBy(key, "_part").orderBy(F.desc("_q"), F.desc("_side"), F.desc("_n._w")).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("_n", F.last("_n", True).over(run)).filter("_side = 0").filter(F.col("_n._t") - F.col("_q") <= int((high - low) * 86_400_000_000))
    return met.select(key, at, F.col("_n.again").alias("again"), (F.col("_n._w") - F.col("_v")).alias("change"))


def nearest(left: DataFrame, right: DataFrame, key: str, at: str, other: str, within: float) -> DataFrame:
    """Each left row with the right row of its key nearest in time, `within` days at most; ties go to the earlier one.

    Time is cut into stretches of `within` days; right rows stand in their own and both next ones, and there each left
    row sees the last right row up to its time and the first after it. So no pairs are made, and no key is one group.
    Left rows without key or time, or without right row near enough, stay with nulls.
    """
    span = int(within * 86_400_000_000)
    time = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rest = [c for c in right.columns if c != key]
    own = left.select(F.col(key).alias("_k"), time(at).alias("_t"), F.struct(*left.columns).alias("_l"), F.lit(1).alias("_side"))
    known = F.col("_k").isNotNull() & F.col("_t").isNotNull()
    seen = right.select(F.col(key).alias("_k"), time(other).alias("_t"), F.struct(*rest).alias("_r"), F.lit(0).alias("_side")).filter(known)
    part = F.floor(F.col("_t") / span) if span else F.col("_t")
    both = own.filter(known).withColumn("_part", part).unionByName(seen.withColumn("_part", F.explode(F.array(part - 1, part, part + 1))), allowMissingColumns=True)
    run = Window.partitionBy("_k", "_part").orderBy("_t", "_side", F.xxhash64("_r"))
    mark = F.when(F.col("_r").isNotNull(), F.struct("_t", "_r"))
    both = both.withColumn("_last", F.last(mark, True).over(run.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_next", F.first(mark, True).over(run.rowsBetween(1, Window.unboundedFollowing)))
    before, after = F.col("_t") - F.col("_last._t"), F.col("_next._t") - F.col("_t")
    best = F.when((before <= span) & (before <= F.coalesce(after, before)), F.col("_last")).when(after <= span, F.col("_next")).when(before <= span, F.col("_last"))
    met = both.filter("_side = 1").select("_l", best.alias("_b")).unionByName(own.filter(~known).select("_l"), allowMissingColumns=True)
    return met.select("_l.*", *[F.col(f"_b._r.{c}").alias(c) for c in rest], ((F.col("_b._t") - time_of("_l", at)) / 8.64e10).alias("delta_days"))


def time_of(row: str, column: str):
    return F.unix_micros(F.col(f"{row}.{column}").cast("timestamp"))


def sheets(frames: dict[str, DataFrame], source: str = "source_sheet") -> DataFrame:
    """All sheets as one table: rows without any value go, missing columns are null, the sheet's name is kept."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.dropna("all").withColumn(source, F.lit(n)) for n, f in frames.items()])
