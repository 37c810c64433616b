"""From a joined table to rows and features to fit: targets, which features are allowed, filters fitted on training rows, gates, reports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import base_person, lookup_name, lookup_text, number, person
from .features import KINEMATIC, kinematic

#: What patient columns are called, and what derived and categorical features are allowed.
ID_COLUMNS = ("Código", "codigo", "ID", "id", "patient_id", "Patient ID")
DERIVED, CATEGORICAL = ("age_at_test", "sex_binary", "delta_dias_digital_papel", "disease_duration_years"), ("clinical_group",)
#: Names of measured movement features by family, and of times of a whole test.
FAMILIES = {
    "inside_circle_time": (r"(inside|dwell|stay|within|in)\s*(circle|circulo)", r"(circle|circulo).*(inside|dwell|stay|within|in)", r"average\s*time\s*inside\s*circles"),
    "flight_time": (r"(flight|vuelo|hover|air)\s*(time|tiempo)", r"(transition|inter|between).*(time|tiempo)", r"average\s*time\s*between\s*circles"),
    "inside_circle_rate": (r"average\s*rate\s*inside\s*circles",),
    "between_circle_rate": (r"average\s*rate\s*between\s*circles",),
    "pressure_mean": (r"(press|pressure|presion).*(mean|avg|media)", r"(mean|avg|media).*(press|pressure|presion)", r"average\s*total\s*pressure"),
    "preselect_letter_time": (r"average\s*time\s*before\s*letters",),
    "preselect_number_time": (r"average\s*time\s*before\s*numbers",),
    "preselect_letter_rate": (r"average\s*rate\s*before\s*letters",),
    "preselect_number_rate": (r"average\s*rate\s*before\s*numbers",),
    "finger_lift_rate": (
        r"(finger|dedo|touch|pen).*(lift|up|levant)", r"(lift|up|levant).*(rate|ratio|freq|frecuencia|count|conteo)",
        r"(air|hover).*(rate|ratio|freq|frecuencia|count|conteo)", r"average\s*lift", r"number\s*lifts",
    ),
    "error_count": (r"number\s*errors",),
}
WHOLE_TIMES = (r"(total|overall|global|completion|complete|duracion|duration).*(time|tiempo)", r"(time|tiempo).*(total|overall|global|completion|complete)")
#: Why training rows drop a feature, in the order in which the filters apply.
REASONS = ("all_nan_in_train", "high_missing_rate_in_train", "low_unique_values_in_train", "low_variance_in_train")


def identifier_column(columns: list[str]) -> str:
    """The column that names the person: the first of the known names, else the first column."""
    return next((c for c in ID_COLUMNS if c in columns), columns[0])


def with_person(frame: DataFrame) -> DataFrame:
    """frame with patient_id and patient_id_base from whichever column names the person."""
    own = F.col(f"`{identifier_column(frame.columns)}`")
    return frame.withColumn("patient_id", person(own)).withColumn("patient_id_base", base_person(own))


def column_roles(catalogue: DataFrame, hints: DataFrame, required: list[str] = []) -> DataFrame:  # noqa: B006
    """(role, column) for each role of hints (role, hint, prio): of a catalogue (col, pos), the column whose name is its first hint
    that any name is, else the first that holds its first hint that any holds, else null; a required role without one is an error.

    Names are compared in lookup form. Hints are few; the catalogue is joined with them by a broadcast.
    """
    few = F.broadcast(hints.withColumn("_h", lookup_text(F.col("hint"))))  # a row a hint
    hits = catalogue.withColumn("_c", lookup_text(F.col("col"))).join(few, F.contains("_c", F.col("_h")))
    first = F.min(F.struct((F.col("_c") != F.col("_h")).alias("part"), "prio", "pos", "col")).alias("_m")
    out = hints.select("role").distinct().join(hits.groupBy("role").agg(first), "role", "left").select("role", F.col("_m.col").alias("column"))
    if required and (missing := [r[0] for r in out.filter(F.col("column").isNull() & F.col("role").isin(*required)).collect()]):
        raise ValueError(f"no column for {', '.join(sorted(missing))}; columns: {', '.join(r[0] for r in catalogue.select('col').distinct().limit(50).collect())}")
    return out


def target_groups(targets: DataFrame, found: DataFrame) -> DataFrame:
    """(group, targets): of targets (name, group, pos), those that column_roles() found a column for, by group, `default` without one."""
    have = found.filter(F.col("column").isNotNull()).select(F.col("role").alias("name"))
    rows = targets.join(have, "name", "left_semi").withColumn("group", F.coalesce("group", F.lit("default")))
    return rows.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("targets"))  # targets are few


def numeric_targets(frame: DataFrame, targets: list[str]) -> DataFrame:
    """frame with its targets as numbers, null where they aren't."""
    return frame.withColumns({t: number(F.col(t).cast("string")) for t in targets})


def not_positive(frame: DataFrame, targets: list[str]) -> DataFrame:
    """(target, not_positive): how many rows of each target are nought or less, which some metrics can't take."""
    return frame.agg(*[F.count_if(F.col(t) <= 0).alias(t) for t in targets]).unpivot([], targets, "target", "not_positive")


def with_targets(frame: DataFrame, targets: list[str], least: int = 10) -> DataFrame:
    """frame without the rows that have none of the targets; an error if under `least` rows are left."""
    left = frame.dropna(how="all", subset=targets)
    if (n := left.limit(least).count()) < least:
        raise ValueError(f"only {n} rows have a target; {least} are needed")
    return left


def exclusion_report(frame: DataFrame, targets: list[str], *by: str) -> DataFrame:
    """(by, rows, dropped, percent): rows without any of the targets."""
    none = F.count_if(F.coalesce(*targets).isNull())
    return frame.groupBy(*by).agg(F.count("*").alias("rows"), none.alias("dropped"), (100 * none / F.count("*")).alias("percent"))


def allowed(frame: DataFrame, measured: list[str], targets: list[str], derived=DERIVED, categorical=CATEGORICAL) -> list[str]:
    """frame's number columns that are measured, allowed derived ones or levels of an allowed categorical one, but no targets."""
    numbers = [f.name for f in frame.schema.fields if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double") or f.dataType.typeName().startswith("decimal")]
    return [c for c in numbers if c not in targets and (c in measured or covariate(c, derived, categorical))]


def covariate(column: str, derived=DERIVED, categorical=CATEGORICAL) -> bool:
    return column in derived or column.startswith(tuple(f"{c}_" for c in categorical))


def without_demography(columns: list[str], derived=DERIVED, categorical=CATEGORICAL) -> list[str]:
    """columns without covariates; bands of education stay."""
    return [c for c in columns if c == "education_band" or c.startswith("education_band_") or not covariate(c, derived, categorical)]


def matching(columns: list[str], patterns: tuple[str, ...]) -> list[str]:
    """Columns whose names, in lookup form, hold one of the patterns."""
    return [c for c in columns if any(re.search(p, lookup_name(c)) for p in patterns)]


def families(columns: list[str]) -> dict[str, list[str]]:
    """The columns of each family of movement features that has any."""
    return {name: found for name, patterns in FAMILIES.items() if (found := matching(columns, patterns))}


def kinematic_of(frame: DataFrame, features: list[str]) -> tuple[DataFrame, list[str]]:
    """frame with the ratios of its families' first columns, and the names of those made."""
    first = {name: found[0] for name, found in families(features).items()}
    made = [f"tmt_kinematic_{n}" for n, a, _, b in KINEMATIC if a in first and b in first]
    return kinematic(frame, {k: f"`{c}`" for k, c in first.items()}), made


def select_families(columns: list[str], priority: list[str], derived=DERIVED, categorical=CATEGORICAL) -> tuple[list[str], list[str]]:
    """(kept, removed times of whole tests): priority columns and covariates, by name, if there are priority ones, else all but those times."""
    whole, first = matching(columns, WHOLE_TIMES), [c for c in columns if c in priority]
    if first:
        kept = sorted({*first, *[c for c in columns if covariate(c, derived, categorical)]})
        return kept, [c for c in whole if c not in kept]
    return [c for c in columns if c not in whole], whole


def train_filters(frame: DataFrame, features: list[str], split: str = "split", most_missing: float = 0.35, least_values: int = 2, least_deviation: float = 1e-8) -> DataFrame:
    """(feature, reason): the first filter that drops a feature for what training rows hold, or `kept`; one aggregate for all.

    In order: no value at all, too many nulls, under `least_values` different values (up to two are told apart by the
    extremes, more are counted), deviation of the population nought or nearly. NaN counts as null.
    """
    train = F.col(split) == "train"
    value = {c: F.when(train & ~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")) for c in features}

    def different(c: str) -> Column:
        if least_values > 2:
            return F.count_distinct(value[c])
        return F.when(F.count(value[c]) == 0, 0).when(F.min(value[c]) == F.max(value[c]), 1).otherwise(2)

    n = F.count_if(train)
    per = [F.struct(F.lit(c).alias("feature"), n.alias("n"), F.count(value[c]).alias("k"), different(c).cast("long").alias("different"), F.stddev_pop(value[c]).alias("sd")) for c in features]
    rows = frame.agg(F.array(*per).alias("all")).select(F.explode("all").alias("s")).select("s.*")
    empty, missing, few, flat = REASONS
    reason = F.when(F.col("k") == 0, empty).when(1 - F.col("k") / F.col("n") > most_missing, missing).when(F.col("different") < least_values, few).when(F.coalesce("sd", F.lit(0.0)) <= least_deviation, flat).otherwise("kept")
    return rows.select("feature", reason.alias("reason"))


def apply_filters(frame: DataFrame, decisions: DataFrame) -> tuple[DataFrame, list[str]]:
    """frame without the features that train_filters() drops, and those kept; decisions hold a row a feature."""
    rows = decisions.collect()
    return frame.drop(*[r.feature for r in rows if r.reason != "kept"]), [r.feature for r in rows if r.reason == "kept"]


def prepare(frame: DataFrame, test: str, measured: list[str], targets: list[str], drop: tuple[str, ...] = (), split: str = "split", derived=DERIVED, categorical=CATEGORICAL):
    """(frame, features, audit): the features of a test's rows that are fitted, and each one left out with its reason.

    The steps, in order: allowed features, for `tmt` without demography, derived features, configured ones dropped, for
    `tmt` families of movement features, then the filters fitted on training rows.
    """
    from .features import FATIGUE, fatigue

    features, audit = allowed(frame, measured, targets, derived, categorical), []
    if test.lower() == "tmt":
        features = without_demography(features, derived, categorical)
        priority = sorted({c for found in families(features).values() for c in found})
        frame, made = kinematic_of(frame, features)
        features, priority = features + made, priority + made
    elif test.lower() == "sdmt":
        before = set(frame.columns)
        frame = fatigue(frame)
        features += [c for c in frame.columns if c.startswith(FATIGUE) and c not in before]
    audit += [("configured", c) for c in drop if c in features]
    features = [c for c in features if c not in drop]
    if test.lower() == "tmt":
        features, times = select_families(features, priority, derived, categorical)
        audit += [("global_time", c) for c in times]
    decisions = train_filters(frame, features, split)
    frame, kept = apply_filters(frame, decisions)
    names = frame.sparkSession.createDataFrame(audit, "reason string, feature string")  # a row a feature
    return frame, kept, names.unionByName(decisions.filter("reason <> 'kept'").select("reason", "feature"))


def sample_gates(frame: DataFrame, targets: list[str], least_train: int = 10, least_test: int = 10, split: str = "split") -> DataFrame:
    """(target, train, test, skipped): rows with each target by split, and why it is skipped, or null; one aggregate for all targets."""
    have = lambda t, s: F.count_if((F.col(split) == s) & F.col(t).isNotNull())
    per = [F.struct(F.lit(t).alias("target"), have(t, "train").alias("train"), have(t, "test").alias("test")) for t in targets]
    rows = frame.agg(F.array(*per).alias("all")).select(F.explode("all").alias("s")).select("s.*")
    return rows.withColumn("skipped", F.when(F.col("train") < least_train, "too few train rows").when(F.col("test") < least_test, "too few test rows"))


def for_model(frame: DataFrame, targets: list[str] | None, column: str = "target") -> DataFrame:
    """Rows of the targets that a model may be fitted to; all, if it names none."""
    return frame if targets is None else frame.filter(F.col(column).isin(*targets))


def audit_only(excluded: dict[str, list[str]], frame: DataFrame) -> DataFrame:
    """(reason, feature): columns of frame that lists exclude, for the audit alone."""
    rows = [(r, c) for r, columns in excluded.items() for c in columns if c in frame.columns]
    return frame.sparkSession.createDataFrame(rows, "reason string, feature string")


def analysis_frame(frame: DataFrame, outcome: str, group: str, covariates: dict[str, str], codes: dict[str, int]) -> DataFrame:
    """(group, outcome, covariates by their new names): groups by code, outcomes as numbers; rows without either go."""
    coded = F.coalesce(*[F.when(F.col(group) == k, F.lit(v)) for k, v in codes.items()])
    new = [F.col(c).alias(n) for n, c in covariates.items() if c in frame.columns]
    return frame.select(coded.alias("group"), number(F.col(outcome).cast("string")).alias("outcome"), *new).dropna(subset=["group", "outcome"])


def minus_log(seconds: Column) -> Column:
    """Times so that more is better; null where there is no logarithm."""
    return F.when(seconds > 0, -F.log(seconds))


def as_ratios(effects: DataFrame) -> DataFrame:
    """Effects (estimate, low, high) on minus_log() as ratios of times, the interval's ends exchanged."""
    return effects.withColumns({"ratio": F.exp(-F.col("estimate")), "ratio_low": F.exp(-F.col("high")), "ratio_high": F.exp(-F.col("low"))})


def impute_mixed(frame: DataFrame, numbers: list[str], categories: list[str], split: str = "split") -> DataFrame:
    """Nulls of numbers take the exact median of training rows, those of categories their most frequent value, the smallest of equals."""
    from .features import impute_median

    out = impute_median(frame, numbers, split) if numbers else frame
    if categories:
        values = F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in categories]))
        long = frame.filter(F.col(split) == "train").select(values).filter("v IS NOT NULL")
        top = long.groupBy("c", "v").agg(F.count("*").alias("n")).groupBy("c").agg(F.min(F.struct((-F.col("n")).alias("n"), "v")).alias("m")).select("c", "m.v")
        modes = {r[0]: r[1] for r in top.collect()}  # a row a category
        out = out.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(modes.get(c))) for c in categories})
    return out


def fixed_levels(frame: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    """frame with a column of 1.0 and 0.0 for each level of each column but its first; a value that isn't a level is an error, null too."""
    unknown = frame.agg(*[F.count_if(~F.coalesce(F.col(c).isin(*known), F.lit(False))).alias(c) for c, known in levels.items()]).first()
    if bad := [f"{c}: {unknown[c]}" for c in levels if unknown[c]]:
        raise ValueError(f"rows with unknown levels: {', '.join(bad)}")
    return frame.withColumns({f"{c}_{v}": F.when(F.col(c) == v, 1.0).otherwise(0.0) for c, known in levels.items() for v in known[1:]})


def participants(frame: DataFrame, key: str, group: str, groups: dict[str, str], covariates: dict[str, str], measures: dict[str, str]) -> DataFrame:
    """One row a row of frame: its group's shown name, the person, covariates trimmed in lower case, age above nought, and each measure as a number."""
    shown = F.coalesce(*[F.when(F.col(group) == k, F.lit(v)) for k, v in groups.items()])
    own = [number(F.col(c).cast("string")).alias(n) if n == "age" else F.lower(F.trim(F.col(c).cast("string"))).alias(n) for n, c in covariates.items()]
    out = frame.select(shown.alias("group"), F.col(key).alias("participant"), *own, *[number(F.col(c).cast("string")).alias(n) for n, c in measures.items()])
    return out.withColumn("age", F.when(F.col("age") > 0, F.col("age"))) if "age" in covariates else out
