"""Tables for discussion: results of several reports as one, the latest of each model, the best of each outcome."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import assessment, status, target
from .agreement import best, latest


def combined(sources: dict[str, DataFrame | None], source: str = "source") -> DataFrame:
    """The same table of several reports, with the report's name; missing ones are skipped, missing columns null."""
    frames = [f.withColumn(source, F.lit(n)) for n, f in sources.items() if f is not None]
    if not frames:
        raise ValueError("no report has the table")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def global_metrics(metrics: DataFrame, model: str = "model", when: str = "timestamp") -> DataFrame:
    """The latest row of each model with its assessment, target and status; rows without a model go, ties go to the larger row."""
    own = metrics.filter(F.col(model).isNotNull()).withColumn("_tie", F.to_json(F.struct(*metrics.columns)))
    named = latest(own, [model], when, "_tie").drop("_tie")
    return named.withColumns({"assessment": assessment(F.col(model)), "target": target(F.col(model)), "clinical_status": status(F.col("r2"), F.col("ccc"), F.col("icc"))})


def best_by_target(named: DataFrame) -> DataFrame:
    """Of global_metrics(), the row of least error of each assessment and target."""
    return best(named, ["assessment", "target"])


def stratified_best(strata: DataFrame, chosen: DataFrame, model: str = "model", when: str = "timestamp") -> DataFrame:
    """The latest rows by model, stratifier and subgroup of the models chosen."""
    own = strata.filter(F.col(model).isNotNull()).join(chosen.select(model).distinct(), model, "left_semi")
    return latest(own.withColumn("_tie", F.to_json(F.struct(*strata.columns))), [model, "stratifier", "subgroup"], when, "_tie").drop("_tie")
