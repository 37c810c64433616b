"""Resampled people: as many draws as people in every replicate and group, weights as counted one by one, leaves of any number."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from oracle import duck, same
from pyspark.sql import functions as F

from concordia import plans
from concordia.operators import discrimination as D
from concordia.operators import draws as W
from concordia.operators import resample as R


def plain_mix(h):
    m = (1 << 64) - 1
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & m
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & m
    return h ^ (h >> 31)


def test_weights_are_those_of_single_draws():
    got = W.weights(7, np.array([5, 0, 9]), 3, 11)
    for b, n in enumerate([5, 0, 9]):
        want = [0] * 7
        state = plain_mix((plain_mix((11 << 32) + b) + 3) % 2**64)
        for j in range(1, n + 1):
            want[plain_mix((state + 0x9E3779B97F4A7C15 * j) % 2**64) % 7] += 1
        assert got[b].tolist() == want


@pytest.mark.parametrize("leaf", [1 << 16, 20, 1])
def test_every_replicate_draws_as_many_as_there_are(spark, monkeypatch, leaf):
    monkeypatch.setattr(W, "LEAF", leaf)
    people = spark.createDataFrame([(i, i % 3 // 2) for i in range(300)] + [(None, 0)], "person int, g int").repartition(4)
    out = D.class_bootstrap(people, "person", "g", 40)
    sums = {(r.replicate, r.g): r.w for r in out.groupBy("replicate", "g").agg(F.sum("w").alias("w")).collect()}
    assert sums == {(b, g): n for b in range(40) for g, n in ((0, 200), (1, 100))}
    each = {r.person: r.w for r in out.groupBy("person").agg(F.sum("w").alias("w")).collect()}
    assert len(each) == 300 and 10 < min(each.values()) and max(each.values()) < 80
    one = out.groupBy("replicate", "person").count().filter("count > 1").count()
    assert one == 0


def test_a_leaf_holds_the_people_of_its_hashes(spark, monkeypatch):
    monkeypatch.setattr(W, "LEAF", 30)
    people = spark.createDataFrame([(f"p{i}", float(i)) for i in range(200)], "person string, v double").repartition(5)

    def seen(part: pd.DataFrame, weight: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"leaf": [int(part["_leaf"][0])], "low": [int(part["_h"].min())], "high": [int(part["_h"].max())], "n": [len(part)], "sorted": [bool(part["_h"].is_monotonic_increasing)]})

    leaves = sorted((r.low, r.high, r.n, r.sorted) for r in W.resampled(people, "person", 3, 5, seen, "leaf int, low long, high long, n int, sorted boolean").collect())
    assert sum(x[2] for x in leaves) == 200 and len(leaves) > 5 and all(x[2] <= 30 and x[3] for x in leaves)
    assert all(a[1] < b[0] for a, b in zip(leaves, leaves[1:], strict=False))
    assert leaves[0][0] == min(int(hashlib.md5(f"5:p{i}".encode()).hexdigest()[:8], 16) for i in range(200))


@pytest.mark.parametrize("leaf", [1 << 16, 15])
def test_bootstrap_weighs_sums_of_people(spark, monkeypatch, leaf):
    monkeypatch.setattr(W, "LEAF", leaf)
    rng = np.random.default_rng(4)
    rows = [(int(i), float(y), float(y + e)) for i, y, e in zip(rng.integers(0, 60, 900), rng.normal(10, 3, 900), rng.normal(0, 1, 900), strict=True)] + [(3, None, 1.0), (None, 1.0, 1.0)]
    frame = spark.createDataFrame(rows, "person int, y double, p double")
    got = {r.replicate: r for r in R.bootstrap(frame, "person", "y", "p", 30).collect()}
    people = frame.select("person").distinct()
    known = [r for r in rows if None not in r]
    plain = W.resampled(people, "person", 30, 42, lambda part, w: pd.DataFrame({"b": np.repeat(np.arange(len(w)), len(part)), "person": np.tile(part["person"].to_numpy(), len(w)), "w": w.ravel()}), "b int, person int, w int").toPandas()
    for b in range(30):
        w = plain[plain.b == b].set_index("person").w
        e = np.concatenate([[p - y] * w[i] for i, y, p in known])
        assert got[b].n == len(e) and got[b].rmse == pytest.approx(np.sqrt((e**2).mean())) and got[b].bias == pytest.approx(e.mean())
    assert R.bootstrap(frame.limit(0), "person", "y", "p", 5).count() == 0


def test_leaves_change_nothing_about_who_is_drawn(spark, monkeypatch):
    people = spark.createDataFrame([(i, [0, 1, None][i % 7 % 3], float(i % 11), float(i % 5)) for i in range(300)], "person int, g int, y double, p double").repartition(4)
    draws = lambda: sorted(map(tuple, D.class_bootstrap(people, "person", "g", 12).collect()), key=str)
    sums = lambda: [(r.replicate, r.n, pytest.approx(r.rmse), pytest.approx(r.bias)) for r in R.bootstrap(people, "person", "y", "p", 12).sort("replicate").collect()]
    one, whole = draws(), sums()
    assert sum(r[3] for r in one) == 12 * people.dropna().count() < 12 * 300
    for leaf, deal in ((20, 64), (1, 1 << 20)):
        monkeypatch.setattr(W, "LEAF", leaf)
        monkeypatch.setattr(W, "DEALT", deal)
        assert draws() == one
        assert sums() == whole


@pytest.mark.parametrize("name", ["bootstrap_intervals", "class_bootstrap_draws", "cluster_bootstrap"])
def test_queries_of_many_leaves_are_as_their_sql(spark, monkeypatch, name):
    monkeypatch.setattr(W, "LEAF", 20)
    sf = "/root/testdata/sf0.001"
    assert same(plans.QUERIES[name](spark, sf).toPandas(), duck(sf).sql(plans.ORACLES[name]).df()) == ""
