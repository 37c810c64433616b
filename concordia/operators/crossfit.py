"""Deviation from a healthy norm as an input of a classifier: no row helps to make its own input, in training folds neither."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .inference import gram, least_squares
from .models import _table
from .strata import line, products

#: Newton steps of a logistic fit.
STEPS = 8


def cross_fitted_deviation(frame: DataFrame, features: list[str], label: str, group: str, outer: str, inner: str, alpha: float = 10.0) -> DataFrame:
    """frame, once for each outer fold `held`, with `role`, test for its rows and train for others, `deviation` and `scaled`.

    The deviation is the label predicted less observed, by a ridge fitted to rows of group 0: a training row's is fitted to
    the other outer folds without its inner fold, a test row's to all training rows. All these fits are differences of one
    table of sums by both folds. `scaled` is the deviation by its deviation among training rows of group 0 (1 if that is
    nought). Folds are few: their sums come to the driver. Rows with a null fold go; those with a null among features and
    label aren't fitted to and have a null deviation, as have those whose fit has no row.
    """
    rows = frame.filter(F.col(outer).isNotNull() & F.col(inner).isNotNull())
    each = gram(rows.filter(F.col(group) == 0), [*features, label], outer, inner)
    folds = rows.select(outer, inner).distinct().collect()
    outers, inners = sorted({r[0] for r in folds}), sorted({r[1] for r in folds})
    fits = []
    for o in outers:
        for i in [*inners, None]:
            kept = [m for (a, b), m in each.items() if a != o and b != i]
            if kept and (m := sum(kept))[0, 0] > 0:
                fits.append((o, i, least_squares(m, alpha).tolist()))
    if not fits:
        raise ValueError("no other fold has a row of group 0 with every feature and the label")
    kind = {c: frame.schema[c].dataType.simpleString() for c in (outer, inner)}
    table = _table(frame, fits, f"_held {kind[outer]}, _inner {kind[inner]}, _b array<double>")
    out = rows.withColumn("held", F.explode(F.array(*[F.lit(o).cast(kind[outer]) for o in outers])))
    out = out.withColumn("role", F.when(F.col(outer) == F.col("held"), "test").otherwise("train"))
    mine = F.when(F.col("role") == "train", F.col(inner))
    out = out.join(table, (F.col("held") == F.col("_held")) & mine.eqNullSafe(F.col("_inner")), "left")
    out = out.withColumn("deviation", line(F.col("_b"), features) - F.col(f"`{label}`")).drop("_held", "_inner", "_b")
    scale = out.filter((F.col("role") == "train") & (F.col(group) == 0)).groupBy(F.col("held").alias("_held")).agg(F.stddev_pop("deviation").alias("_sd"))
    scales = _table(frame, [tuple(r) for r in scale.collect()], f"_held {kind[outer]}, _sd double")
    return out.join(scales, F.col("held") == F.col("_held"), "left").withColumn("scaled", F.col("deviation") / F.when(F.col("_sd") > 1e-12, F.col("_sd")).otherwise(1.0)).drop("_held", "_sd")


def fold_scores(rows: DataFrame, features: list[str], label: str, output: str = "score", strength: float = 1.0) -> DataFrame:
    """rows of cross_fitted_deviation() with a logistic score, fitted for each held fold to its training rows.

    Features are scaled by the training rows, and the penalty is of inverse strength over the summed loss. A Newton step is
    one aggregate for all folds. Rows with a null among features and label aren't fitted to; a null feature gives a null
    score, and so does a fold whose training rows have one class only.
    """
    size = len(features) + 1
    value = [F.col(f"`{c}`").cast("double").alias(f"_x{k}") for k, c in enumerate(features)]
    own = rows.filter(F.col("role") == "train").select("held", F.col(f"`{label}`").cast("double").alias("_t"), *value).dropna().persist()
    x = [F.col(f"_x{k}") for k in range(size - 1)]
    upper = np.triu_indices(size)

    def square(values) -> np.ndarray:
        m = np.zeros((size, size))
        m[upper] = values
        return m + np.triu(m, 1).T

    to, beta = {}, {}
    for r in own.groupBy("held").agg(F.array(*[F.sum(p) for p in products(x, [])]).alias("m"), F.sum("_t").alias("ones"), F.count("*").alias("n")).collect():
        if 0 < r.ones < r.n:
            m = square(r.m)
            mean = m[0] / r.n
            sd = np.sqrt(np.maximum(np.diag(m) / r.n - mean**2, 0))
            sd = np.where(sd > 1e-12, sd, 1.0)
            to[r.held] = np.diag(1 / np.append(1.0, sd[1:]))
            to[r.held][1:, 0] = -mean[1:] / sd[1:]
            beta[r.held] = np.zeros(size)
    kind = rows.schema["held"].dataType.simpleString()
    table = lambda: _table(rows, [(h, (to[h].T @ b).tolist()) for h, b in beta.items()], f"held {kind}, _b array<double>")
    names = [f"_x{k}" for k in range(size - 1)]
    for _ in range(STEPS if beta else 0):
        p = 1 / (1 + F.exp(-line(F.col("_b"), names)))
        terms = [F.array(*[F.sum((F.col("_t") - p) * v) for v in (F.lit(1.0), *x)]).alias("g"), F.array(*[F.sum(p * (1 - p) * v) for v in products(x, [])]).alias("h")]
        for r in own.join(table(), "held").groupBy("held").agg(*terms).collect():
            pull = np.append(0.0, np.full(size - 1, 1 / strength))
            t = to[r.held]
            beta[r.held] = beta[r.held] + np.linalg.solve(t @ square(r.h) @ t.T + np.diag(pull), t @ np.array(r.g) - pull * beta[r.held])
    own.unpersist()
    return rows.join(table(), "held", "left").withColumn(output, 1 / (1 + F.exp(-line(F.col("_b"), features)))).drop("_b")
