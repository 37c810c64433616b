"""How well scores tell two groups apart, with every model fitted anew in each fold of each replicate, all replicates at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .draws import resampled
from .ranking import cumulative
from .resample import _ranked, draw

#: Newton steps of a logistic fit.
STEPS = 8


def class_bootstrap(people: DataFrame, person: str, group: str, replicates: int, seed: int = 42) -> DataFrame:
    """(replicate, person, group, w): how often each person is drawn, as many draws from each group as it has people."""
    def drawn(part: pd.DataFrame, weight: np.ndarray) -> pd.DataFrame:
        b, i = np.nonzero(weight)
        return pd.DataFrame({"replicate": b.astype(np.int32), person: part[person].to_numpy()[i], group: part[group].to_numpy()[i], "w": weight[b, i].astype(np.int64)})

    kind = {c: people.schema[c].dataType.simpleString() for c in (person, group)}
    return resampled(people.select(person, group), person, replicates, seed, drawn, f"replicate int, `{person}` {kind[person]}, `{group}` {kind[group]}, w long", group)


def all_seeds(people: DataFrame, person: str, group: str, seeds: list[int]) -> DataFrame:
    """(replicate, person, group, w): everybody once for each seed, which then is the replicate."""
    return people.select(F.explode(F.array(*[F.lit(s) for s in seeds])).alias("replicate"), person, group, F.lit(1).cast("long").alias("w"))


def replicate_folds(draws: DataFrame, person: str, group: str, k: int = 5, seed: int = 42) -> DataFrame:
    """draws with `fold`: within each replicate and group people are dealt in turn by hash, all copies of one together."""
    ranked = _ranked(draws, [draw(F.lit(seed) + F.col("replicate"), F.col(person)), F.col(person)], "replicate", group)
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank", "_all")


def _moments(x: list, w):
    n = range(len(x))
    return [F.sum(w * x[i] * x[j]) for i in n for j in n if i <= j]


def _square(values, size: int) -> np.ndarray:
    m, at = np.zeros((size, size)), 0
    for i in range(size):
        for j in range(i, size):
            m[i, j] = m[j, i] = values[at] or 0.0
            at += 1
    return m


def discrimination(frame: DataFrame, person: str, group: str, y: str, base: list[str], draws: DataFrame, k: int = 5, seed: int = 42, alpha: float = 10.0, strength: float = 1.0) -> DataFrame:
    """(replicate, auc_base, auc_more, auc_deviation, increment) of out-of-fold scores, a row a replicate of draws.

    Scores are a logistic model's on `base`, one's on `base` and y, and how far y is below a ridge fitted to group 0.
    Folds are dealt by hash within group and replicate, a person's copies together. Features are scaled by the training
    folds. Replicates in which a group has under k people are left out. The driver gets sums of products by replicate
    and fold, whatever the number of rows; each Newton step is one aggregate for all replicates, folds and models.
    """
    spark, size = frame.sparkSession, len(base) + 2
    marked = replicate_folds(draws, person, group, k, seed)
    enough = draws.groupBy("replicate", group).agg(F.count_distinct(person).alias("n")).groupBy("replicate").agg(F.min("n").alias("n"), F.count("*").alias("g")).filter((F.col("n") >= k) & (F.col("g") == 2)).select("replicate")
    folds = marked.join(enough, "replicate", "left_semi").select("replicate", person, "w", "fold")
    own = frame.select(person, F.col(group).cast("double").alias("_t"), F.array(F.lit(1.0), *[F.col(c).cast("double") for c in base], F.col(y).cast("double")).alias("_x")).filter(~F.exists("_x", lambda v: v.isNull()))
    rows = folds.join(own, person).persist()
    x = [F.get("_x", F.lit(i)) for i in range(size)]
    sums = rows.groupBy("replicate", "fold").agg(F.array(*_moments(x, F.col("w"))).alias("a"), F.array(*_moments(x, F.col("w") * (1 - F.col("_t")))).alias("c")).collect()
    every = {(r.replicate, r.fold): (_square(r.a, size), _square(r.c, size)) for r in sums}
    whole: dict = {}
    for (b, _), (a, c) in every.items():
        have = whole.get(b, (0, 0))
        whole[b] = have[0] + a, have[1] + c
    fits, beta = {}, {}
    for (b, f), (a, c) in every.items():
        train, control = whole[b][0] - a, whole[b][1] - c

        def scaling(m: np.ndarray) -> np.ndarray:
            """The matrix that takes (1, features) to (1, scaled features)."""
            mean = m[0] / m[0, 0]
            sd = np.sqrt(np.maximum(np.diag(m) / m[0, 0] - mean**2, 0))
            sd = np.where(sd > 1e-12, sd, 1.0)
            t = np.diag(1 / np.append(1.0, sd[1:]))
            t[1:, 0] = -mean[1:] / sd[1:]
            return t

        t = scaling(control[:-1, :-1])
        z = t @ control[:-1, :-1] @ t.T
        ridge = t.T @ np.linalg.solve(z + alpha * np.diag([0.0] + [1.0] * (size - 2)), t @ control[:-1, -1])
        fits[b, f] = scaling(train), ridge
        beta[b, f] = [np.zeros(size - 1), np.zeros(size)]

    def table() -> DataFrame:
        values = [(b, f, *[v.tolist() for v in beta[b, f]], fits[b, f][1].tolist()) for b, f in fits]
        return F.broadcast(spark.createDataFrame(values, "replicate int, held int, base array<double>, more array<double>, ridge array<double>"))  # a row a replicate and fold

    def dot(coefficients: str, n: int):
        return sum((x[i] * F.get(coefficients, F.lit(i)) for i in range(1, n)), F.get(coefficients, F.lit(0)))

    for _ in range(STEPS if fits else 0):
        both = rows.join(table(), "replicate").filter("fold <> held")
        parts = []
        for name, n in (("base", size - 1), ("more", size)):
            p = 1 / (1 + F.exp(-dot(name, n)))
            parts += [F.array(*[F.sum(F.col("w") * (F.col("_t") - p) * x[i]) for i in range(n)]).alias(f"g_{name}"), F.array(*_moments(x[:n], F.col("w") * p * (1 - p))).alias(f"h_{name}")]
        for r in both.groupBy("replicate", "held").agg(*parts).collect():
            for k_, (name, n) in enumerate((("base", size - 1), ("more", size))):
                t = fits[r.replicate, r.held][0][:n, :n]
                now = np.linalg.solve(t.T, beta[r.replicate, r.held][k_])  # of scaled features
                pull = np.append(0.0, now[1:]) / strength
                step = np.linalg.solve(t @ _square(r[f"h_{name}"], n) @ t.T + np.diag([0.0] + [1.0 / strength] * (n - 1)), t @ np.array(r[f"g_{name}"]) - pull)
                beta[r.replicate, r.held][k_] = t.T @ (now + step)
    rows.unpersist()  # the result, read later, is worked out from the inputs
    if not fits:
        return spark.createDataFrame([], "replicate int, auc_base double, auc_more double, auc_deviation double, increment double")
    scored = rows.join(table(), "replicate").filter("fold = held")
    scores = F.inline(F.array(*[F.struct(F.lit(m).alias("m"), s.alias("s")) for m, s in (("base", dot("base", size - 1)), ("more", dot("more", size)), ("deviation", dot("ridge", size - 1) - x[size - 1]))]))
    each = scored.select("replicate", "w", "_t", scores).groupBy("replicate", "m", "s").agg(F.sum("w").alias("ties"), F.sum(F.col("w") * F.col("_t")).alias("pos"))
    ranked = cumulative(each, "s", ["ties", "pos"], "replicate", "m", few=True).withColumn("rank", F.col("before_ties") + (F.col("ties") + 1) / 2)
    n1, n0 = F.sum("pos"), F.sum(F.col("ties") - F.col("pos"))
    area = ranked.groupBy("replicate", "m").agg(((F.sum(F.col("rank") * F.col("pos")) - n1 * (n1 + 1) / 2) / F.nullif(n1 * n0, F.lit(0.0))).alias("auc"))
    pick = lambda m: F.max(F.when(F.col("m") == m, F.col("auc")))
    return area.groupBy("replicate").agg(pick("base").alias("auc_base"), pick("more").alias("auc_more"), pick("deviation").alias("auc_deviation"), (pick("more") - pick("base")).alias("increment"))
