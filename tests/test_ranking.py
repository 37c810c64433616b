"""Ranks and order statistics against numpy: outliers, heavy values, nulls, NaN, many groups, empty frames."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from concordia.operators import agreement as A
from concordia.operators import ranking as O
from concordia.operators import resample as R


def groups(seed=3):
    rng = random.Random(seed)
    out = {
        "even": [rng.gauss(0, 1) for _ in range(9000)],
        "narrow": [1 + rng.random() * 2e-4 for _ in range(8000)] + [1e15],
        "heavy": [5.0] * 6000 + [rng.random() * 10 for _ in range(3000)],
        "odd": [3.0, -1.0, 2.0],
        "one": [7.0],
        "negative": [-(10 ** rng.uniform(-300, 300)) for _ in range(3001)],
        None: [float(rng.randint(0, 40)) for _ in range(5000)],
    }
    return {k: v + ([None, float("nan")] if k in ("odd", "even") else []) for k, v in out.items()} | {"none": [None, float("nan")]}


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(k, x) for k, values in groups().items() for x in values]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "g string, v double").repartition(5).persist()


def clean(values):
    return sorted(x for x in values if x is not None and x == x)


def test_ranges_hold_under_a_hundredth_of_a_groups_values(spark):
    each = spark.range(200_000).select((1 + F.col("id") * 1e-9).alias("value"), F.lit(1).alias("ties")).union(spark.createDataFrame([(1e15, 1)], "value double, ties int"))
    sizes = [r[1] for r in O.parted(each, O.splitters(each, "value", ["ties"]), "value").groupBy("_range").count().collect()]
    assert sum(sizes) == 200_001 and len(sizes) >= 100 and max(sizes) < 2000


@pytest.mark.parametrize("few", [True, False])
def test_cumulative(frame, few):
    each = O.counted(frame, F.col("v"), "g")
    got = {(r.g, r.value): (r.before_ties, r.all_ties) for r in O.cumulative(each, "value", ["ties"], "g", few=few).collect()}
    for g, values in groups().items():
        known = np.array(clean(values))
        for x in known[:: max(1, len(known) // 300)]:
            assert got[g, x] == (int((known < x).sum()), len(known))
    assert len(got) == sum(len(set(clean(v))) for v in groups().values())


@pytest.mark.parametrize(("small", "most"), [(2000, 1_000_000), (2000, 1), (10, 1), (10**9, 1_000_000)])
def test_selected(frame, monkeypatch, small, most):
    monkeypatch.setattr(O, "SMALL", small)
    monkeypatch.setattr(O, "SORTED", most)
    if small == 10:
        monkeypatch.setattr(O, "REACH", 0.3)  # ranks of a few rows are within three of their share only
    n = F.col("n")
    wanted = {"low": (0.1, F.ceil(n * 0.1)), "mid": (0.5, F.floor((n + 1) / 2)), "high": (0.9, F.least(n, F.ceil(n * 0.9) + 1))}
    got = {r.g: r for r in O.selected(frame, F.col("v"), wanted, "g", extra=(F.count("*").alias("rows"),)).collect()}
    for g, values in groups().items():
        known, r = clean(values), got[g]
        assert (r["rows"], r["_n"]) == (len(values), len(known))
        m = len(known)
        at = [int(np.ceil(m * 0.1)), (m + 1) // 2, min(m, int(np.ceil(m * 0.9)) + 1)]
        assert [r.low, r.mid, r.high] == ([known[k - 1] for k in at] if m else [None] * 3)


def test_median_of_many_groups_and_of_none(spark, frame, monkeypatch):
    want = {g: float(np.median(clean(v))) if clean(v) else None for g, v in groups().items()}
    assert {r.g: r.m for r in O.with_median(frame, F.col("v"), "m", "g").collect()} == pytest.approx(want)
    monkeypatch.setattr(O, "MANY", 2)
    assert {r.g: r.m for r in O.with_median(frame, F.col("v"), "m", "g").collect()} == pytest.approx(want)
    whole = clean(x for v in groups().values() for x in v)
    assert O.with_median(frame, F.col("v"), "m").collect() == [(float(np.median(whole)),)]
    assert O.with_median(frame.limit(0), F.col("v"), "m", "g").collect() == []
    assert O.with_median(frame.limit(0), F.col("v"), "m").collect() == [(None,)]


def test_the_rows_are_read_once_for_all_steps(spark, frame, tmp_path):
    frame.write.parquet(f"{tmp_path}/rows")
    each = O.counted(spark.read.parquet(f"{tmp_path}/rows"), F.col("v"), "g")
    out = O.cumulative(each, "value", ["ties"], "g", few=True)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1 and plan.count("ReusedExchange") >= 2


def test_conformal_width(frame):
    for alpha in (0.05, 0.1, 0.5):
        got = {r.g: r.q for r in R.conformal(frame, "v", alpha, False, "g").collect()}
        for g, values in groups().items():
            known = sorted(abs(x) for x in clean(values))
            if m := len(known):
                level = min(1.0, np.ceil((m + 1) * (1 - alpha)) / m)
                assert got[g] == known[int(np.ceil(level * (m - 1)))]
        assert "none" not in got


def test_latest_and_best(spark):
    rows = [("a", 1, 5, "x"), ("a", 3, 1, "y"), ("a", 3, 2, "z"), ("a", None, 9, "w"), ("b", None, 1, "v"), ("b", None, None, "u"), (None, 2, 2, "t")]
    frame = spark.createDataFrame(rows, "k string, t int, tie int, v string")
    assert {r.k: r.v for r in A.latest(frame, ["k"], "t", "tie").collect()} == {"a": "z", "b": "v", None: "t"}
    models = [("y", "m1", 2.0, 1.0, 0.5), ("y", "m2", 1.0, 3.0, 0.1), ("y", "m3", 1.0, 3.0, 0.9), ("y", "m4", None, 0.0, 1.0), ("y", "m5", float("nan"), 0.0, 1.0)]
    assert [r.model for r in A.best(spark.createDataFrame(models, "target string, model string, rmse double, mae double, ccc double"), ["target"]).collect()] == ["m3"]
