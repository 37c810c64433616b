"""Models by name, ridge with nested folds, normative deviation: fits are MLlib's or sums over rows by fold."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .inference import gram, least_squares

#: MLlib's deepest tree, for a depth without limit.
DEEPEST = 30


def estimator(name: str, features: list[str], label: str, **options) -> Pipeline:
    """An unfitted pipeline from columns to `prediction`: linear, logistic, rf, rf_classifier or boosted."""
    common = {"featuresCol": "_features", "labelCol": label}
    makers = {
        "linear": lambda: LinearRegression(**common, solver="normal", **options),
        "logistic": lambda: LogisticRegression(**common, standardization=False, **options),
        "rf": lambda: RandomForestRegressor(**common, featureSubsetStrategy="all", **{"maxDepth": DEEPEST, "seed": 42} | options),
        "rf_classifier": lambda: RandomForestClassifier(**common, **{"maxDepth": DEEPEST, "seed": 42} | options),
        "boosted": lambda: GBTRegressor(**common, **{"seed": 42} | options),
    }
    if name not in makers:
        raise ValueError(f"unknown model {name}; there are {', '.join(sorted(makers))}")
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="skip"), makers[name]()])


def logistic(frame: DataFrame, features: list[str], label: str, c: float = 1.0):
    """A fitted logistic pipeline whose penalty is that of inverse strength c over the summed loss."""
    rows = frame.dropna(subset=[*features, label])
    return estimator("logistic", features, label, regParam=1.0 / (c * rows.count())).fit(rows)


def line(coefficients, features: list[str]) -> Column:
    """The linear prediction; coefficients are an array column, or values, the intercept first."""
    at = (lambda k: F.get(coefficients, F.lit(k))) if isinstance(coefficients, Column) else (lambda k: F.lit(float(coefficients[k])))
    return sum((at(k + 1) * F.col(f).cast("double") for k, f in enumerate(features)), at(0))


def _table(frame: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(frame.sparkSession.createDataFrame(rows, schema))  # a row a fold and penalty


def normative_deviation(frame: DataFrame, features: list[str], label: str, group: str, fold: str, alpha: float = 10.0) -> DataFrame:
    """frame with `deviation`, predicted less observed, by a ridge fitted to rows of group 0 in the other folds.

    Rows with a null among label and features aren't fitted to, and have a null deviation; so have folds whose others
    hold no row of group 0. Rows without a fold go.
    """
    each = gram(frame.filter((F.col(group) == 0) & F.col(fold).isNotNull()), [*features, label], fold)
    whole = sum(each.values(), np.zeros((len(features) + 2,) * 2))
    wanted = [r[0] for r in frame.select(fold).filter(F.col(fold).isNotNull()).distinct().collect()]
    fits = [(k, least_squares(m, alpha).tolist()) for k in wanted for m in [whole - each.get((k,), 0)] if m[0, 0] > 0]
    table = _table(frame, fits, f"{fold} {frame.schema[fold].dataType.simpleString()}, _b array<double>")
    return frame.filter(F.col(fold).isNotNull()).join(table, fold, "left").withColumn("deviation", line(F.col("_b"), features) - F.col(label)).drop("_b")


def nested_ridge(frame: DataFrame, features: list[str], label: str, outer: str, inner: str, alphas: tuple[float, ...] = (0.1, 1.0, 10.0, 100.0)) -> DataFrame:
    """frame with `alpha` and `prediction`: for each outer fold, the penalty of least mean absolute error over the inner folds
    of the others, ties to the smaller, and the ridge with it fitted to the others.

    All fits come from one aggregate by both folds; one more pass scores the penalties. Rows with a null among label,
    features and folds go.
    """
    rows = frame.dropna(subset=[*features, label, outer, inner])
    each = gram(rows, [*features, label], outer, inner)
    outers, inners = sorted({o for o, _ in each}), sorted({i for _, i in each})

    def fit(without_outer, without_inner, alpha):
        kept = [m for (o, i), m in each.items() if o != without_outer and i != without_inner]
        return least_squares(sum(kept), alpha).tolist() if kept else None

    kind = {c: frame.schema[c].dataType.simpleString() for c in (outer, inner)}
    tried = [(o, i, a, b) for o in outers for i in inners for a in alphas if (b := fit(o, i, a))]
    scored = rows.withColumnRenamed(outer, "_own").join(_table(frame, tried, f"{outer} {kind[outer]}, {inner} {kind[inner]}, alpha double, _b array<double>"), inner).filter(F.col("_own") != F.col(outer))
    mae = scored.groupBy(outer, "alpha").agg(F.avg(F.abs(line(F.col("_b"), features) - F.col(label))).alias("mae"))
    best = {r[0]: r.best.alpha for r in mae.groupBy(outer).agg(F.min(F.struct("mae", "alpha")).alias("best")).collect()}
    final = [(o, a, fit(o, None, a)) for o, a in best.items()]
    return rows.join(_table(frame, final, f"{outer} {kind[outer]}, alpha double, _b array<double>"), outer).withColumn("prediction", line(F.col("_b"), features)).drop("_b")


def feature_audit(frame: DataFrame, reasons: str, name: str) -> DataFrame:
    """(reason, feature): a row for each feature in each list of the map column `reasons`, and `selected` for those in none of `name`'s.

    `reasons` maps a reason to the features it removed; `name` is an array column of all features. Nulls give no rows.
    """
    removed = frame.select(F.explode(reasons).alias("reason", "_f")).select("reason", F.explode("_f").alias("feature"))
    left = frame.select(F.explode(F.array_except(name, F.coalesce(F.flatten(F.map_values(reasons)), F.array().cast("array<string>")))).alias("feature"))
    return removed.unionByName(left.select(F.lit("selected").alias("reason"), "feature")).distinct()
