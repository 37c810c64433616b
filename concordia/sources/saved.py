"""Calibrators, and the models they hold, kept in a folder: one line of JSON, and MLlib's own folders beside it."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from ..operators.calibrator import Calibrator
from ..operators.learning import CountClasses, Linear, Stacked

#: The version of the format.
VERSION = 1


def _stored(spark: SparkSession, model, path: str) -> dict:
    """A description of a model; what MLlib has fitted is saved below path."""
    if isinstance(model, Linear):
        if not all(isinstance(t, str) for t in model.terms.values()):
            raise ValueError("a linear model is saved with terms of SQL text")
        return {"kind": "linear", "terms": list(model.terms.items()), "coefficients": [float(c).hex() for c in model.coefficients]}
    if isinstance(model, Stacked):
        return {"kind": "stacked", "bases": [[n, _stored(spark, m, f"{path}/{n}")] for n, m in model.bases.items()], "meta": _stored(spark, model.meta, path)}
    if isinstance(model, CountClasses):
        inner = None if model.model is None else _stored(spark, model.model, f"{path}/classes")
        return {"kind": "count_classes", "model": inner, "only": model.only, "values": list(model.values.items())}
    if isinstance(model, PipelineModel):
        model.write().overwrite().save(path)
        return {"kind": "pipeline"}
    raise ValueError(f"a {type(model).__name__} can't be saved")


def _restored(kept: dict, path: str):
    kind = kept["kind"]
    if kind == "linear":
        return Linear(dict(kept["terms"]), [float.fromhex(c) for c in kept["coefficients"]])
    if kind == "stacked":
        return Stacked({n: _restored(m, f"{path}/{n}") for n, m in kept["bases"]}, _restored(kept["meta"], path))
    if kind == "count_classes":
        return CountClasses(kept["model"] and _restored(kept["model"], f"{path}/classes"), kept["only"], {k: v for k, v in kept["values"]})
    return PipelineModel.load(path)


def save(spark: SparkSession, calibrator: Calibrator, path: str) -> None:
    """Keeps a calibrator in a folder of any file system that Spark writes, in place of an earlier one."""
    c = calibrator
    head = {"version": VERSION, "name": c.name, "features": c.features, "label": c.label, "rows": c.rows, "ranges": list(c.ranges.items()), "scale": list(c.scale.items()), "model": _stored(spark, c.model, f"{path}/model")}
    spark.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/head")


def load(spark: SparkSession, path: str) -> Calibrator:
    """The calibrator that save() kept there; another version of the format is an error."""
    head = json.loads(spark.read.text(f"{path}/head").first()[0])
    if head["version"] != VERSION:
        raise ValueError(f"{path} is of version {head['version']}, not {VERSION}")
    pairs = lambda name: {f: tuple(v) for f, v in head[name]}
    return Calibrator(head["name"], head["features"], head["label"], head["rows"], pairs("ranges"), pairs("scale"), _restored(head["model"], f"{path}/model"))
