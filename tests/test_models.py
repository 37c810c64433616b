"""Models against closed forms in numpy."""

import numpy as np
import pytest

from concordia.operators import models as M


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(90, 2))
    y = x @ [2.0, -1.0] + 0.5 + rng.normal(size=90)
    return [(i, float(a), float(b), float(t), i % 3, (i // 3) % 3, i % 2) for i, ((a, b), t) in enumerate(zip(x, y))]


SCHEMA = "i int, a double, b double, y double, outer int, inner int, g int"


def ridge(rows, alpha):
    m = np.array(rows)
    x, y = m[:, 1:3], m[:, 3]
    c = x - x.mean(0)
    w = np.linalg.solve(c.T @ c + alpha * np.eye(2), c.T @ (y - y.mean()))
    return lambda r: y.mean() + (np.array(r[1:3]) - x.mean(0)) @ w


def test_nested_ridge(spark, table):
    frame = spark.createDataFrame([*table, (900, None, 1.0, 1.0, 0, 0, 0)], SCHEMA)
    got = {r.i: (r.alpha, r.prediction) for r in M.nested_ridge(frame, ["a", "b"], "y", "outer", "inner").collect()}
    assert len(got) == 90
    for o in range(3):
        others, errors = [r for r in table if r[4] != o], {}
        for alpha in (0.1, 1.0, 10.0, 100.0):
            errors[alpha] = np.mean([abs(f(r) - r[3]) for k in range(3) for f in [ridge([r for r in others if r[5] != k], alpha)] for r in others if r[5] == k])
        best = min(errors, key=errors.get)
        f = ridge(others, best)
        for r in table:
            if r[4] == o:
                assert got[r[0]][0] == best and got[r[0]][1] == pytest.approx(f(r))


def test_normative_deviation(spark, table):
    frame = spark.createDataFrame([*table, (900, None, 1.0, 1.0, 0, 0, 0)], SCHEMA)
    got = {r.i: r.deviation for r in M.normative_deviation(frame, ["a", "b"], "y", "g", "outer").collect()}
    assert got.pop(900) is None and len(got) == 90
    for o in range(3):
        f = ridge([r for r in table if r[4] != o and r[6] == 0], 10.0)
        for r in table:
            if r[4] == o:
                assert got[r[0]] == pytest.approx(f(r) - r[3])


def test_logistic_is_the_penalised_optimum(spark, table):
    frame = spark.createDataFrame([(r[1], r[2], float(r[3] > 0)) for r in table], "a double, b double, t double")
    fitted = M.logistic(frame, ["a", "b"], "t").stages[-1]
    w, b = fitted.coefficients.toArray(), fitted.intercept
    x, t = np.array([r[1:3] for r in table]), np.array([r[3] > 0 for r in table], float)
    residual = 1 / (1 + np.exp(-(x @ w + b))) - t
    assert abs(residual.sum()) < 1e-2 and np.abs(x.T @ residual + w).max() < 1e-2


def test_models_by_name(spark, table):
    frame = spark.createDataFrame(table, SCHEMA)
    for name, options in (("linear", {}), ("rf", {"numTrees": 10, "maxDepth": 5}), ("boosted", {"maxIter": 5})):
        out = M.estimator(name, ["a", "b"], "y", **options).fit(frame).transform(frame).toPandas()
        assert ((out.prediction - out.y) ** 2).mean() < out.y.var()
    with pytest.raises(ValueError, match="boosted, linear"):
        M.estimator("none", ["a"], "y")


def test_feature_audit(spark):
    frame = spark.createDataFrame([({"null_rate": ["a"], "constant": ["b", "c"]}, ["a", "b", "c", "d"]), (None, ["e"])], "reasons map<string,array<string>>, all array<string>")
    got = sorted(tuple(r) for r in M.feature_audit(frame, "reasons", "all").collect())
    assert got == [("constant", "b"), ("constant", "c"), ("null_rate", "a"), ("selected", "d"), ("selected", "e")]
