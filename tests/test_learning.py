"""Splines, stacking, search, elimination, count classes, exact ranks and discussion tables."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from concordia.functions import columns as C
from concordia.operators import discussion as D
from concordia.operators import features as X
from concordia.operators import inference as I
from concordia.operators import learning as L


@pytest.fixture(scope="module")
def curve(spark):
    x = np.linspace(-1, 3, 121)
    noise = np.random.default_rng(5).normal(size=(121, 4))
    rows = [(i, float(v), float(np.sin(2 * v) + 0.05 * e[0]), float(e[1]), float(e[2]), float(e[3]), i % 3) for i, (v, e) in enumerate(zip(x, noise))]
    return spark.createDataFrame(rows, "i int, x double, y double, a double, b double, c double, fold int").cache()


def test_spline_terms_are_a_partition_of_unity(spark, curve):
    terms = L.spline_terms(curve, ["x", "fold"], knots=5, degree=3)
    assert len(terms) == 7 and "fold" in terms
    got = curve.select("x", *[F.expr(c).alias(n) for n, c in terms.items() if n != "fold"]).toPandas().sort_values("x")
    total = got.drop(columns="x").sum(axis=1).to_numpy()
    assert (got.to_numpy()[:, 1:] >= -1e-12).all()
    assert total[:90] == pytest.approx(1.0) and total[-1] < 1  # the last basis function is left out
    out = spark.createDataFrame([(-9.0,), (-1.0,), (None,)], "x double").select(*[F.expr(c).alias(n) for n, c in terms.items() if n != "fold"]).collect()
    assert list(out[0]) == pytest.approx(list(out[1])) and not any(v is not None for v in out[2])


def test_spline_gam_bends(curve):
    wide = L.spline_gam(curve, ["x"], "y", alpha=0.01, knots=8).transform(curve).toPandas()
    straight = L.ridge(curve, {"x": F.col("x")}, "y").transform(curve).toPandas()
    assert ((wide.prediction - wide.y) ** 2).mean() < 0.02 < ((straight.prediction - straight.y) ** 2).mean()
    with pytest.raises(ValueError, match="no row"):
        L.ridge(curve.filter("false"), {"x": F.col("x")}, "y")


def test_stack(curve):
    options = {"rf": {"numTrees": 8, "maxDepth": 5}, "boosted": {"maxIter": 4}}
    out = L.stack(curve, ["x", "a"], "y", "fold", options=options).transform(curve).toPandas()
    assert len(out) == 121 and {"base_ridge", "base_rf", "base_boosted"} <= set(out)
    assert ((out.prediction - out.y) ** 2).mean() < 0.3 * out.y.var()
    with pytest.raises(ValueError, match="two folds"):
        L.stack(curve.filter("fold = 0"), ["x"], "y", "fold", options=options)


def test_search(curve):
    grid = {"maxDepth": [1, 4], "numTrees": [5]}
    best, rmse, model, tried = L.search(curve, "rf", ["x"], "y", "fold", grid)
    assert best == {"maxDepth": 4, "numTrees": 5} and tried.count() == 2
    assert rmse == pytest.approx(tried.agg(F.min("rmse")).first()[0])
    assert L.search(curve, "rf", ["x"], "y", "fold", grid, tries=1)[3].count() == 1
    assert [r.feature for r in L.importance(curve, model, ["x"]).collect()] == ["x"]


def test_elimination_keeps_what_tells(curve):
    left = L.eliminate(curve, ["a", "b", "c", "x"], "y", most=2, least=1, step=0.3, trees=10, depth=4)
    assert len(left) == 2 and "x" in left
    assert L.eliminate(curve.limit(5), ["a", "b", "c", "x"], "y", most=1) == ["a", "b", "c", "x"]


def test_count_classes(spark, curve):
    counts = curve.withColumn("n", F.when(F.col("x") < 0, 0.0).when(F.col("x") < 1, 1.0).when(F.col("x") < 2, 2.5).otherwise(7.0))
    fit = L.count_classifier(counts, ["x"], "n", numTrees=5)
    assert fit.values == {0: 0.0, 1: 1.0, 2: 2.0, 3: 7.0}
    out = fit.transform(counts).toPandas()
    assert (out.prediction == np.where(out.n == 2.5, 2.0, out.n)).mean() > 0.95
    alone = L.count_classifier(counts.filter("n = 7"), ["x"], "n", binary=True)
    assert alone.model is None and alone.values == {0: 0.0, 1: 7.0} and alone.transform(counts).select("prediction").distinct().collect()[0][0] == 7.0
    with pytest.raises(ValueError, match="no row"):
        L.count_classifier(counts.filter("false"), ["x"], "n")


def test_several_outputs(curve):
    models = L.several_outputs(curve.withColumn("z", F.when(F.col("i") > 5, F.col("x") * 2)), "linear", ["x", "a"], ["y", "z"])
    out = L.predict_several(curve, models).toPandas()
    assert out.prediction_z.to_numpy() == pytest.approx(2 * out.x.to_numpy(), abs=1e-6) and "prediction_y" in out
    with pytest.raises(ValueError, match="two labels"):
        L.several_outputs(curve, "linear", ["x"], ["y"])


def test_exact_rank_test_counts_all_orders():
    for n1, n0 in ((1, 4), (3, 4), (5, 2)):
        each = [sum(a > b for a in s for b in set(range(n1 + n0)) - set(s)) for s in itertools.combinations(range(n1 + n0), n1)]
        for u in range(n1 * n0 + 1):
            want = min(1.0, 2 * np.mean([v >= max(u, n1 * n0 - u) for v in each]))
            assert I.mann_whitney_exact(u, n1, n0) == pytest.approx(want)
    assert I.mann_whitney_exact(0, 0, 3) == 1.0
    assert 0 < I.mann_whitney_exact(1500, 8, 300) < 1


def test_kinematic(spark):
    frame = spark.createDataFrame([(6.0, 2.0, 3), (5.0, 0.0, None)], "inside double, flight double, errors int")
    out = X.kinematic(frame, {"inside_circle_time": "inside", "flight_time": "flight", "error_count": "errors"}).collect()
    assert [c for c in out[0].asDict() if c.startswith("tmt_")] == ["tmt_kinematic_circle_to_flight_ratio", "tmt_kinematic_circle_minus_flight", "tmt_kinematic_errors_per_between_time"]
    assert list(out[0])[3:] == [3.0, 4.0, 1.5] and list(out[1])[3:] == [None, 5.0, None]


def test_discussion_tables(spark):
    schema = "model string, timestamp string, rmse double, mae double, r2 double, ccc double, icc double"
    one = spark.createDataFrame([("m1_sdmt_paper_score", "2024-01-01", 1.0, 1.0, 0.9, 0.9, 0.9), ("m1_sdmt_paper_score", "2024-02-01", 3.0, 1.0, 0.9, 0.9, 0.9), (None, "2024-01-01", 0.0, 0.0, 0.0, 0.0, 0.0)], schema)
    two = spark.createDataFrame([("m2_sdmt_paper_score", "2024-01-01", 2.0, 1.0, -0.1, 0.9, 0.9), ("other", None, 1.0, 1.0, 0.5, 0.5, None)], schema)
    named = D.global_metrics(D.combined({"a": one, "gone": None, "b": two}))
    got = {r.model: (r.rmse, r.assessment, r.target, r.clinical_status, r.source) for r in named.collect()}
    assert got == {"m1_sdmt_paper_score": (3.0, "SDMT", "sdmt_paper_score", "Promising for discussion", "a"), "m2_sdmt_paper_score": (2.0, "SDMT", "sdmt_paper_score", "Needs major improvement", "b"), "other": (1.0, "Unknown", "other", "Exploratory / moderate", "b")}
    chosen = D.best_by_target(named)
    assert {r.model for r in chosen.collect()} == {"m2_sdmt_paper_score", "other"}
    strata = spark.createDataFrame([("other", "sex", "F", "2024-01-01", 1), ("other", "sex", "F", "2024-03-01", 2), ("m1_sdmt_paper_score", "sex", "F", "2024-03-01", 3)], "model string, stratifier string, subgroup string, timestamp string, n int")
    assert [r.n for r in D.stratified_best(strata, chosen).collect()] == [2]
    with pytest.raises(ValueError, match="no report"):
        D.combined({"a": None})
    assert [tuple(r) for r in spark.createDataFrame([("x_TMT",), (None,)], "m string").select(C.assessment(F.col("m")), C.target(F.col("m"))).collect()] == [("TMT", "x_TMT"), ("Unknown", "Unknown")]
