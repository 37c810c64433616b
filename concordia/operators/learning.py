"""Splines, stacking, search, elimination, count classes and several outputs; fits are MLlib's or sums over rows."""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import balanced_weight, error_class
from .inference import gram, least_squares
from .models import estimator, line
from .ranking import with_median

#: What stands for a class of counts that training doesn't hold.
STAND_IN = {0: 0.0, 1: 1.0, 2: 2.0, 3: 4.0}


@dataclass(frozen=True)
class Linear:
    """A linear prediction from named terms, each an expression over the columns of a frame, best as SQL text, which can be saved."""

    terms: dict[str, str | Column]
    coefficients: list[float]

    def transform(self, frame: DataFrame, output: str = "prediction") -> DataFrame:
        """frame with the prediction, null where a term is; the terms' columns go again."""
        named = {f"_t{k}": _column(c) for k, c in enumerate(self.terms.values())}
        return frame.withColumns(named).withColumn(output, line(self.coefficients, list(named))).drop(*named)


def _column(term: str | Column) -> Column:
    return F.expr(term) if isinstance(term, str) else term


def ridge(frame: DataFrame, terms: dict[str, str | Column], label: str, alpha: float = 1.0) -> Linear:
    """The ridge of label on the terms, its intercept free, from one aggregate over rows without nulls among them."""
    named = [_column(c).cast("double").alias(f"_t{k}") for k, c in enumerate(terms.values())]
    own = frame.select(*named, F.col(label).cast("double").alias("_y"))
    m = gram(own, own.columns)[()]
    if not m[0, 0]:
        raise ValueError("no row has a value in every term and the label")
    return Linear(terms, least_squares(m, alpha).tolist())


def several_values(frame: DataFrame, columns: list[str], least: int) -> set[str]:
    """Columns with `least` different values at least: an estimate settles all but those near the bound, which are counted."""
    about = frame.agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in columns]).first()
    near = [c for c in columns if least / 2 <= about[c] <= 2 * least]
    exact = {c: frame.select(c).dropna().distinct().limit(least).count() for c in near}
    return {c for c in columns if exact.get(c, about[c]) >= least}


def _real(x: float) -> str:
    return f"({float(x)!r}D)"


def spline_terms(train: DataFrame, features: list[str], knots: int = 5, degree: int = 3, least_values: int = 6) -> dict[str, str]:
    """Terms, as SQL text, of a uniform B-spline between the training minimum and maximum of each feature, but for the last of each.

    Values outside count as the nearest bound. Features of fewer different values, or of one value, are terms themselves.
    A null gives null terms. A basis function is the sum of truncated powers over its knots, so no recursion is needed.
    """
    smooth = several_values(train, features, max(2, least_values))
    bounds = train.agg(*[f(F.col(c).cast("double")).alias(f"{n}{k}") for k, c in enumerate(features) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    terms = {}
    for k, c in enumerate(features):
        x, lo, hi = f"CAST(`{c}` AS DOUBLE)", bounds[f"lo{k}"], bounds[f"hi{k}"]
        if c not in smooth or not lo < hi:
            terms[c] = x
            continue
        inside = f"(least(greatest({x}, {_real(lo)}), {_real(hi)}) - {_real(lo)}) / {_real((hi - lo) / (knots - 1))}"
        for j in range(knots + degree - 2):
            u = f"({inside} + {_real(degree - j)})"
            powers = [f"power(greatest({u} - {_real(i)}, 0D), {_real(degree)}) * {_real((-1) ** i * math.comb(degree + 1, i) / math.factorial(degree))}" for i in range(degree + 1)]
            terms[f"{c}_s{j}"] = f"CASE WHEN {x} IS NULL THEN NULL WHEN {u} > 0 AND {u} < {degree + 1} THEN {' + '.join(powers)} ELSE 0D END"
    return terms


def spline_gam(train: DataFrame, features: list[str], label: str, alpha: float = 1.0, knots: int = 5, degree: int = 3, least_values: int = 6) -> Linear:
    """An additive model: a ridge on the spline terms of all features."""
    rows = train.dropna(subset=[*features, label])
    return ridge(rows, spline_terms(rows, features, knots, degree, least_values), label, alpha)


def _predict(model, frame: DataFrame, output: str) -> DataFrame:
    if isinstance(model, Linear):
        return model.transform(frame, output)
    return model.transform(frame).withColumnRenamed("prediction", output).drop("_features", "rawPrediction", "probability")


@dataclass(frozen=True)
class Stacked:
    """Fitted base models and the ridge that weighs their predictions."""

    bases: dict[str, object]
    meta: Linear

    def transform(self, frame: DataFrame) -> DataFrame:
        """frame with `base_<name>` of each base model and `prediction`; rows with a null feature go."""
        for name, model in self.bases.items():
            frame = _predict(model, frame, f"base_{name}")
        return self.meta.transform(frame)


def stack(frame: DataFrame, features: list[str], label: str, fold: str, alpha: float = 1.0, options: dict[str, dict] | None = None) -> Stacked:
    """Ridge, forest and boosted trees, weighed by a ridge fitted to what each predicts for folds that it hasn't seen.

    Each row gets all its out-of-fold predictions in one scan of its fold, so nothing is joined by row. The folds, few,
    are those of `frame`; fewer than two are an error. Rows with a null among features, label and fold go. `options`
    are those of each base by name (ridge, rf, boosted).
    """
    rows = frame.dropna(subset=[*features, label, fold]).persist()
    options = {"ridge": {"alpha": alpha}, "rf": {}, "boosted": {}} | (options or {})
    kinds = [r[0] for r in rows.select(fold).distinct().sort(fold).collect()]
    if len(kinds) < 2:
        rows.unpersist()
        raise ValueError("stacking needs two folds or more")

    def fit(name: str, train: DataFrame):
        if name == "ridge":
            return ridge(train, {f: f"`{f}`" for f in features}, label, **options[name])
        return estimator(name, features, label, **options[name]).fit(train)

    unseen = None
    for k in kinds:
        held = rows.filter(F.col(fold) == k)
        for name in options:
            held = _predict(fit(name, rows.filter(F.col(fold) != k)), held, f"base_{name}")
        unseen = held if unseen is None else unseen.unionByName(held)
    out = Stacked({n: fit(n, rows) for n in options}, ridge(unseen, {n: f"`base_{n}`" for n in options}, label, 1.0))
    rows.unpersist()
    return out


def search(frame: DataFrame, name: str, features: list[str], label: str, fold: str, grid: dict[str, list], tries: int | None = None, seed: int = 42, parallelism: int = 2) -> tuple[dict, float, PipelineModel, DataFrame]:
    """The best settings of a model, their error, the model fitted with them to all rows, and the error of all settings tried.

    Settings are the whole grid, or `tries` of it drawn without replacement; the error is the mean over folds of the root
    mean squared error. `fold` is a whole number from 0. Rows with a null among features, label and fold go.
    """
    rows = frame.dropna(subset=[*features, label, fold]).withColumn(fold, F.col(fold).cast("int"))
    folds = rows.agg(F.count_distinct(fold)).first()[0]
    if folds < 2:
        raise ValueError("a search needs two folds or more")
    pipeline = estimator(name, features, label)
    builder = ParamGridBuilder()
    for k, values in grid.items():
        builder = builder.addGrid(pipeline.getStages()[-1].getParam(k), values)
    maps = builder.build()
    if tries is not None and tries < len(maps):
        maps = random.Random(seed).sample(maps, tries)
    fitted = CrossValidator(estimator=pipeline, estimatorParamMaps=maps, evaluator=RegressionEvaluator(labelCol=label, metricName="rmse"), numFolds=folds, foldCol=fold, seed=seed, parallelism=parallelism).fit(rows.persist())
    rows.unpersist()
    settings = [{p.name: v for p, v in m.items()} for m in maps]
    at = min(range(len(maps)), key=lambda i: fitted.avgMetrics[i])
    tried = frame.sparkSession.createDataFrame([({k: str(v) for k, v in s.items()}, float(e)) for s, e in zip(settings, fitted.avgMetrics, strict=True)], "settings map<string,string>, rmse double")
    return settings[at], fitted.avgMetrics[at], fitted.bestModel, tried


def importance(frame: DataFrame, model: PipelineModel, features: list[str], most: int | None = None) -> DataFrame | None:
    """(feature, importance) of a fitted tree model, the largest first; None for other models."""
    values = getattr(model.stages[-1], "featureImportances", None)
    if values is None:
        return None
    ranked = sorted(zip(features, values.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))
    return frame.sparkSession.createDataFrame(ranked[:most], "feature string, importance double")


def eliminate(frame: DataFrame, features: list[str], label: str, most: int = 24, least: int = 8, step: float = 0.2, trees: int = 300, depth: int = 8) -> list[str]:
    """The features left when, while there are over `most`, those of least importance to a forest go, a share `step` at a time.

    Never fewer than `least` are left; ties in importance go by name. With three features or fewer than ten rows, all are.
    """
    rows = frame.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*features, label])]).dropna(subset=[*features, label])  # what is kept
    if len(features) <= 3 or rows.limit(10).count() < 10:
        return list(features)
    left = list(features)
    rows = rows.persist()
    while len(left) > most and len(left) > least:
        model = estimator("rf", left, label, numTrees=trees, maxDepth=depth).fit(rows)
        weights = dict(zip(left, model.stages[-1].featureImportances.toArray().tolist(), strict=True))
        gone = set(sorted(left, key=lambda f: (weights[f], f))[: min(max(1, int(len(left) * step)), len(left) - least)])
        left = [f for f in left if f not in gone]
    rows.unpersist()
    return left


@dataclass(frozen=True)
class CountClasses:
    """A forest over classes of counts, or the one class there was, and the count that stands for each class."""

    model: PipelineModel | None
    only: int
    values: dict[int, float]

    def transform(self, frame: DataFrame) -> DataFrame:
        """frame with `prediction`, the count that stands for the class predicted."""
        if self.model is None:
            return frame.withColumn("prediction", F.lit(self.values[self.only]))
        out = _predict(self.model, frame, "_class")
        stands = F.coalesce(*[F.when(F.col("_class") == k, F.lit(v)) for k, v in self.values.items()])
        return out.withColumn("prediction", stands).drop("_class")


def count_classifier(train: DataFrame, features: list[str], label: str, binary: bool = False, **options) -> CountClasses:
    """Counts as classes (none and some, or 0, 1, 2 to 3 and more), classes weighed alike, and each class's rounded median.

    Counts are rounded half to even. Rows with a null among features and label go; none left is an error.
    """
    rows = train.dropna(subset=[*features, label]).withColumn("_class", error_class(F.col(label).cast("double"), binary))
    medians = with_median(rows, F.rint(label), "m", "_class").withColumn("m", F.rint("m")).collect()
    if not medians:
        raise ValueError("no row has all features and a count")
    known = {k: v for k, v in STAND_IN.items() if not binary or k < 2}
    values = known | {r["_class"]: max(float(min(r["_class"], 1)), r.m) for r in medians}
    if len(medians) == 1:
        return CountClasses(None, medians[0]["_class"], values)
    model = estimator("rf_classifier", features, "_class", weightCol="weight", **options).fit(balanced_weight("_class")(rows))
    return CountClasses(model, -1, values)


def several_outputs(frame: DataFrame, name: str, features: list[str], labels: list[str], **options) -> dict[str, PipelineModel]:
    """A model for each of two labels or more, all fitted to the rows that have every feature and label."""
    if len(labels) < 2:
        raise ValueError("several outputs need two labels or more")
    rows = frame.dropna(subset=[*features, *labels])
    return {y: estimator(name, features, y, **options).fit(rows) for y in labels}


def predict_several(frame: DataFrame, models: dict[str, PipelineModel]) -> DataFrame:
    """frame with `prediction_<label>` of each model; rows with a null feature go."""
    for y, model in models.items():
        frame = _predict(model, frame, f"prediction_{y}")
    return frame
