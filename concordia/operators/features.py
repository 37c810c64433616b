"""Train-fitted feature preparation and within-session features."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import lookup_name, ratio
from .quality import date_like, id_like
from .ranking import with_median

#: Parts of the names of columns of sexes.
SEXES = ("sexo", "sex", "gender", "genero")
#: Derived movement features, each of two families of measured ones.
KINEMATIC = (
    ("circle_to_flight_ratio", "inside_circle_time", "/", "flight_time"),
    ("circle_minus_flight", "inside_circle_time", "-", "flight_time"),
    ("inside_to_between_rate_ratio", "inside_circle_rate", "/", "between_circle_rate"),
    ("inside_minus_between_rate", "inside_circle_rate", "-", "between_circle_rate"),
    ("letter_to_number_pretime_ratio", "preselect_letter_time", "/", "preselect_number_time"),
    ("letter_minus_number_pretime", "preselect_letter_time", "-", "preselect_number_time"),
    ("letter_to_number_prerate_ratio", "preselect_letter_rate", "/", "preselect_number_rate"),
    ("letter_minus_number_prerate", "preselect_letter_rate", "-", "preselect_number_rate"),
    ("pressure_per_lift", "pressure_mean", "/", "finger_lift_rate"),
    ("pressure_lift_interaction", "pressure_mean", "*", "finger_lift_rate"),
    ("lift_per_flight", "finger_lift_rate", "/", "flight_time"),
    ("errors_per_between_time", "error_count", "/", "flight_time"),
)


def _train(c: str, split: str):
    return F.when(F.col(split) == "train", F.col(c).cast("double"))


def profile(frame: DataFrame, features: list[str], split: str = "split") -> DataFrame:
    """(feature, reason): why training rows would drop a feature, or `kept`; one aggregate for all features."""
    n = F.sum(F.when(F.col(split) == "train", 1).otherwise(0))
    per = [F.struct(F.lit(c).alias("feature"), n.alias("n"), F.count(_train(c, split)).alias("k"), F.min(_train(c, split)).alias("lo"), F.max(_train(c, split)).alias("hi"), F.stddev_pop(_train(c, split)).alias("sd")) for c in features]
    rows = frame.agg(F.array(*per).alias("all")).select(F.explode("all").alias("s")).select("s.*")
    reason = F.when(F.col("k") == 0, "all_null").when(1 - F.col("k") / F.col("n") > 0.35, "null_rate").when(F.col("lo") == F.col("hi"), "constant").when(F.col("sd") <= 1e-8, "low_variance").otherwise("kept")
    return rows.select("feature", reason.alias("reason"))


def impute_mean(frame: DataFrame, features: list[str], split: str = "split") -> DataFrame:
    """Nulls take the mean of training rows."""
    means = frame.agg(*[F.avg(_train(c, split)).alias(f"_m_{c}") for c in features])
    return frame.crossJoin(F.broadcast(means)).withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")) for c in features}).drop(*[f"_m_{c}" for c in features])


def impute_median(frame: DataFrame, features: list[str], split: str = "split") -> DataFrame:
    """Nulls take the exact median of training rows, found by counts of values, all features at once."""
    if not features:
        return frame
    each = F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in features]))
    long = frame.filter(F.col(split) == "train").select(each)
    found = with_median(long, F.col("v"), "median", "c")
    m = found.agg(*[F.max(F.when(F.col("c") == c, F.col("median"))).alias(f"_m_{c}") for c in features])
    return frame.crossJoin(F.broadcast(m)).withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")) for c in features}).drop(*[f"_m_{c}" for c in features])


def standardize(frame: DataFrame, features: list[str], split: str = "split") -> DataFrame:
    """(x - mean) / population deviation of training rows; a constant feature is only centred."""
    s = frame.agg(*[f(_train(c, split)).alias(f"_{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = frame.crossJoin(F.broadcast(s)).withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 1e-8, F.col(f"_s_{c}")).otherwise(1.0) for c in features})
    return out.drop(*[f"_{n}_{c}" for c in features for n in ("m", "s")])


#: Names of features, by what they measure: times, and errors and counts.
LOGGED = (r"(time|tiempo|latency|latencia|duration|duracion|delay|dwell|flight|hover|air)", r"(error|errores|mistake|count|conteo|n_?)")


def log_candidates(columns: list[str]) -> list[str]:
    """Columns whose names, in lookup form, speak of times, errors or counts (any name with an n does, as the last pattern says)."""
    return [c for c in columns if any(re.search(p, lookup_name(c)) for p in LOGGED)]


def log_transform(frame: DataFrame, features: list[str], split: str = "split") -> DataFrame:
    """log(1 + x), x at least 0, of features whose training rows aren't all null and hold nothing negative; nulls stay null."""
    lows = frame.agg(*[F.min(_train(c, split)).alias(c) for c in features]).first() if features else {}
    raised = lambda c: F.when(F.col(c).isNotNull(), F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0))))
    return frame.withColumns({c: raised(c) for c in features if lows[c] is not None and lows[c] >= 0})


def one_hot(frame: DataFrame, columns: list[str] | None = None, most: int = 6, exclude: tuple[str, ...] = ()) -> DataFrame:
    """A column of 1.0 and 0.0 for each level of text columns with 2 to `most` levels; null rows are 0.0 in all.

    With a list only its columns count. Columns to exclude and those named like dates, identifiers or sexes are left as
    they are; truth values become 1.0, 0.0 and null. One aggregate estimates how many levels each column has, and one
    more collects those of the columns that have few.
    """
    kinds = {f.name: f.dataType.simpleString() for f in frame.schema.fields}
    left_out = lambda c: c in exclude or date_like(c) or id_like(c) or any(h in c.lower() for h in SEXES)
    taken = [c for c in kinds if (columns is None or c in columns) and not left_out(c)]
    frame = frame.withColumns({c: F.col(f"`{c}`").cast("double") for c in taken if kinds[c] == "boolean"})
    text = [c for c in taken if kinds[c] == "string"]
    if not text:
        return frame
    about = frame.agg(*[F.approx_count_distinct(f"`{c}`", 0.01).alias(f"n{k}") for k, c in enumerate(text)]).first()
    near = [c for k, c in enumerate(text) if 2 <= about[k] <= 2 * most]
    if not near:
        return frame
    levels = frame.agg(*[F.array_sort(F.collect_set(f"`{c}`")).alias(f"l{k}") for k, c in enumerate(near)]).first()
    return frame.withColumns({f"{c}_{v}": F.when(F.col(f"`{c}`") == v, 1.0).otherwise(0.0) for c, own in zip(near, levels, strict=True) if 2 <= len(own) <= most for v in own})


def target_proxy(frame: DataFrame, targets: list[str]) -> DataFrame:
    """frame with `proxy`: the mean of the row's z-scored targets, nulls left out."""
    s = frame.agg(*[f(c).alias(f"_{n}_{c}") for c in targets for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = [(F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 1e-8, F.col(f"_s_{c}")).otherwise(1.0) for c in targets]
    total, count = sum((F.coalesce(x, F.lit(0.0)) for x in z), F.lit(0.0)), sum((x.isNotNull().cast("int") for x in z), F.lit(0))
    return frame.crossJoin(F.broadcast(s)).withColumn("proxy", total / F.nullif(count, F.lit(0))).drop(*[f"_{n}_{c}" for c in targets for n in ("m", "s")])


def terciles(events: DataFrame, person: str, order: list[str], error) -> DataFrame:
    """(person, numdig1..3, numerr1..3): right and wrong answers in each third of a person's events."""
    third = events.withColumn("_t", F.ntile(3).over(Window.partitionBy(person).orderBy(*order)))
    count = lambda t, bad: F.sum(F.when((F.col("_t") == t) & (error if bad else ~error), 1).otherwise(0))
    return third.groupBy(person).agg(*[count(t, bad).alias((WRONG if bad else RIGHT)[t - 1]) for bad in (False, True) for t in (1, 2, 3)])


#: The counters of right and wrong answers by third of a test, and the prefix of features made of them.
RIGHT, WRONG, FATIGUE = ("numdig1", "numdig2", "numdig3"), ("numerr1", "numerr2", "numerr3"), "sdmt_fatigue_"


def fatigue(frame: DataFrame) -> DataFrame:
    """frame with features of how a test's last third differs from its first, for those of both blocks of counters it has whole.

    Right answers give six, wrong ones four, both together two. Any is null where a counter is or where it divides by nought.
    """
    has = {block: set(block) <= set(frame.columns) for block in (RIGHT, WRONG)}
    new: dict = {}

    def changes(name: str, block: tuple[str, ...]) -> dict:
        one, two, three = (F.col(c).cast("double") for c in block)
        rise = three - one
        return {f"{name}_total_terciles": one + two + three, f"{name}_last_minus_first": rise, f"{name}_last_over_first": ratio(three, one), f"{name}_slope": rise / 2}

    if has[RIGHT]:
        one, two, three = (F.col(c).cast("double") for c in RIGHT)
        new |= changes("correct", RIGHT) | {"correct_mid_drop": two - one, "correct_end_drop": three - two}
    if has[WRONG]:
        new |= changes("error", WRONG)
    if has[RIGHT] and has[WRONG]:
        first, last = (ratio(F.col(r).cast("double"), F.col(r) + F.col(w)) for r, w in ((RIGHT[0], WRONG[0]), (RIGHT[2], WRONG[2])))
        new |= {"accuracy_last_minus_first": last - first, "accuracy_last_over_first": ratio(last, first)}
    return frame.withColumns({FATIGUE + n: c for n, c in new.items()}) if new else frame


def kinematic(frame: DataFrame, families: dict[str, str]) -> DataFrame:
    """frame with the ratios, differences and products of those families that `families` gives a column for.

    A ratio is null where its denominator is nought; any is null where a part is.
    """
    make = {"/": ratio, "-": lambda a, b: a - b, "*": lambda a, b: a * b}
    value = {f: F.col(c).cast("double") for f, c in families.items()}
    return frame.withColumns({f"tmt_kinematic_{n}": make[op](value[a], value[b]) for n, a, op, b in KINEMATIC if a in value and b in value})


def error_class(c, binary: bool = False):
    """Counts as classes: 0 and more, or 0, 1, 2 to 3 and more; rounded half to even first."""
    r = F.rint(c)
    return F.when(r <= 0, 0).when(F.lit(binary) | (r <= 1), 1).when(r <= 3, 2).when(r > 3, 3)


def balanced_weight(label: str):
    """n / (classes * rows of the class), from counts over classes."""

    def weigh(frame: DataFrame) -> DataFrame:
        each = frame.groupBy(label).agg(F.count("*").alias("_c"))
        each = each.withColumn("weight", F.sum("_c").over(Window.partitionBy()) / (F.count("*").over(Window.partitionBy()) * F.col("_c"))).drop("_c")
        return frame.join(F.broadcast(each), label)  # a row a class

    return weigh


def common_support(frame: DataFrame, value: str, group: str) -> DataFrame:
    """Rows whose value lies between the largest minimum and the smallest maximum of the groups."""
    each = frame.groupBy(group).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    both = each.agg(F.max("lo").alias("_lo"), F.min("hi").alias("_hi"))
    return frame.crossJoin(F.broadcast(both)).filter(F.col(value).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
