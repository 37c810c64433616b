"""Models by name with a life cycle: checked before training, scaled, and held against the ranges of training when they predict."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .agreement import boundaries
from .learning import _predict, count_classifier, ridge, spline_gam, stack
from .models import estimator

#: Names of models: those of MLlib, and those made of sums over rows or of other models.
PLAIN, MADE = ("linear", "logistic", "rf", "rf_classifier", "boosted"), ("ridge", "gam", "ensemble", "error_classifier")


@dataclass(frozen=True)
class Calibrator:
    """A fitted model, the features it takes, in order, and what training rows held: extremes, mean and deviation of each."""

    name: str
    features: list[str]
    label: str
    rows: int
    ranges: dict[str, tuple[float, float]]
    scale: dict[str, tuple[float, float]]
    model: object

    def scaled(self, frame: DataFrame) -> DataFrame:
        """frame with `_z<k>` for each feature, in the order of training, less its mean, by its deviation."""
        if missing := [f for f in self.features if f not in frame.columns]:
            raise ValueError(f"features are missing: {', '.join(missing)}")
        return frame.withColumns({f"_z{k}": (F.col(f"`{f}`").cast("double") - self.scale[f][0]) / self.scale[f][1] for k, f in enumerate(self.features)})

    def predict(self, frame: DataFrame) -> DataFrame:
        """frame, its columns in any order, with `prediction`; rows with a null feature go or have a null prediction, by model."""
        return _predict(self.model, self.scaled(frame), "prediction").drop(*[f"_z{k}" for k in range(len(self.features))])

    def outside(self, frame: DataFrame) -> DataFrame:
        """(feature, lo, hi, seen_lo, seen_hi, violations) of the features that have values outside the range of training."""
        own = frame.select(*[F.col(f"`{f}`").cast("double").alias(f) for f in self.features])
        ranges = frame.sparkSession.createDataFrame([(f, *self.ranges[f]) for f in self.features], "feature string, lo double, hi double")
        return boundaries(own, ranges, self.features).filter("violations > 0")


def train(frame: DataFrame, name: str, features: list[str], label: str, fold: str | None = None, **options) -> Calibrator:
    """A Calibrator of that name, by one aggregate over frame and the model's own fit.

    An unknown name, no features, no rows, and a null among features or label are errors. `ensemble` needs a fold.
    """
    if name not in PLAIN + MADE:
        raise ValueError(f"unknown model {name}; there are {', '.join(sorted(PLAIN + MADE))}")
    if not features:
        raise ValueError("there are no features")
    value = [F.col(f"`{f}`").cast("double") for f in features]
    nulls = [F.count_if(v.isNull() | F.isnan(v)) for v in [*value, F.col(label).cast("double")]]
    per = [x for v in value for x in (F.min(v), F.max(v), F.avg(v), F.stddev_pop(v))]
    seen = frame.agg(F.count("*"), *nulls, *per).first()
    if not seen[0]:
        raise ValueError("there are no rows to train on")
    if bad := [c for c, n in zip([*features, label], seen[1 : len(nulls) + 1], strict=True) if n]:
        raise ValueError(f"nulls in {', '.join(bad)}")
    each = [seen[len(nulls) + 1 + 4 * k :][:4] for k in range(len(features))]
    ranges = {f: (lo, hi) for f, (lo, hi, _, _) in zip(features, each, strict=True)}
    scale = {f: (mean, sd if sd > 1e-12 else 1.0) for f, (_, _, mean, sd) in zip(features, each, strict=True)}
    empty = Calibrator(name, list(features), label, seen[0], ranges, scale, None)
    rows, named = empty.scaled(frame), [f"_z{k}" for k in range(len(features))]
    if name == "ridge":
        model = ridge(rows, {z: z for z in named}, label, **options)
    elif name == "gam":
        model = spline_gam(rows, named, label, **options)
    elif name == "ensemble":
        if fold is None:
            raise ValueError("an ensemble needs a column of folds")
        model = stack(rows, named, label, fold, **options)
    elif name == "error_classifier":
        model = count_classifier(rows, named, label, **options)
    else:
        model = estimator(name, named, label, **options).fit(rows)
    return Calibrator(name, list(features), label, seen[0], ranges, scale, model)
