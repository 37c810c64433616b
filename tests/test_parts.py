"""Models by stratum and target group, conformal quantiles and cross-fitted deviations against numpy and plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from concordia.operators import crossfit as V
from concordia.operators import quantiles as U
from concordia.operators import ranking as O
from concordia.operators import strata as S


def ridge(x, y, alpha):
    x, y = np.array(x, float), np.array(y, float)
    c = x - x.mean(0)
    w = np.linalg.solve(c.T @ c + alpha * np.eye(x.shape[1]), c.T @ (y - y.mean(0)))
    return np.vstack([y.mean(0) - x.mean(0) @ w, w])


def people(seed=5, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        k = rng.choice(["a", "a", "b", None]) if i > 12 else "small"
        x, g = rng.gauss(0, 1), rng.gauss(0, 2)
        rows.append((i % 60 if k != "small" else 1000 + i, k, x, g, {"a": 2 * x, "b": -x}.get(k, 0.5) + g + rng.gauss(0, 0.3), x - g + rng.gauss(0, 1)))
    return rows + [(7, "a", None, 1.0, 1.0, 1.0), (8, "b", 1.0, 1.0, None, 1.0), (None, "a", 1.0, 1.0, 99.0, 99.0)]


SCHEMA = "person int, k string, x double, g double, y double, z double"
TEST = [(1, "a", 0.5, 1.0), (2, "b", 0.5, 1.0), (3, "small", 0.5, 1.0), (4, "new", 0.5, 1.0), (5, None, 0.5, 1.0), (6, "a", None, 1.0)]


@pytest.fixture(scope="module")
def train(spark):
    return spark.createDataFrame(people(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def test(spark):
    return spark.createDataFrame(TEST, "id int, k string, x double, g double")


@pytest.mark.parametrize("few", [True, False])
def test_strata_fall_back_to_all_rows(train, test, monkeypatch, few):
    if not few:
        monkeypatch.setattr(S, "MANY", 1)
    out = S.stratum_models(train, ["x", "g"], ["y", "z"], "k", "person", alpha=2.0, least_rows=20).predict(test)
    got = {r.id: r for r in out.collect()}
    known = [r for r in people() if None not in (r[0], *r[2:])]
    for i, k, x, g in TEST:
        own = [r for r in known if r[1] == k] if k in ("a", "b") else known
        assert got[i].route == (k if k in ("a", "b") else "GLOBAL")
        b = ridge([r[2:4] for r in own], [r[4:6] for r in own], 2.0)
        if x is None:
            assert got[i].prediction_y is None
        else:
            assert [got[i].prediction_y, got[i].prediction_z] == pytest.approx(list(np.array([1, x, g]) @ b))
        assert got[i].low_y is None and got[i].high_z is None
    assert len(got) == len(TEST)


def test_a_stratum_with_one_person_has_no_model(spark, test):
    rows = [(1, "a", float(i), 1.0, 2.0 * i, 0.0) for i in range(30)] + [(i, "b", float(i), 1.0, -1.0 * i, 0.0) for i in range(30)]
    out = S.stratum_models(spark.createDataFrame(rows, SCHEMA), ["x"], ["y"], "k", "person").predict(test)
    assert {r.k: r.route for r in out.collect()} == {"a": "GLOBAL", "b": "b", "small": "GLOBAL", "new": "GLOBAL", None: "GLOBAL"}


def test_intervals_only_if_every_part_has_one(train, test):
    models = S.stratum_models(train, ["x", "g"], ["y"], "k", "person", least_rows=5, miscoverage=0.2)
    assert {r._k: r._ready for r in models.parts.collect()} == {"a": True, "b": True, "small": False, None: True}
    assert all(r.low is None for r in models.predict(test).collect())
    got = models.predict(test.filter("k <> 'small'")).collect()
    assert all(r.low < r.prediction < r.high for r in got if r.x is not None)
    width = {r.route: r.high - r.low for r in got if r.x is not None}
    assert len(set(width.values())) == len(width) == 3 - (None in {r.k for r in got})


def test_every_row_must_have_a_prediction(train, test):
    models = S.stratum_models(train, ["x", "g"], ["y"], "k", "person")
    assert models.predict(test.dropna(subset=["x"]), strict=True).count() == 5
    with pytest.raises(Exception, match="no prediction"):
        models.predict(test, strict=True).collect()
    with pytest.raises(ValueError, match="no row"):
        S.stratum_models(train.limit(0), ["x"], ["y"], "k", "person")


def test_target_groups(spark, train):
    rows = train.withColumn("y", F.when(F.col("person") % 3 > 0, F.col("y")))
    groups = {"both": ["y", "z"], "one": ["z"], "none": ["empty"]}
    out = S.target_groups_models(rows.withColumn("empty", F.lit(None).cast("double")), ["x", "g"], groups, 1.5)
    got = {r.target_group: r for r in out.collect()}
    known = [r for r in people() if None not in r[2:4]]
    whole = [r for r in known if r[4] is not None and r[0] is not None and r[0] % 3 > 0]
    assert got["both"].n == len(whole) and got["one"].n == len(known) and got["none"].n == 0 and got["none"].coefficients is None
    assert np.allclose(got["both"].coefficients, ridge([r[2:4] for r in whole], [r[4:6] for r in whole], 1.5).T)
    assert np.allclose(got["one"].coefficients, ridge([r[2:4] for r in known], [r[5:6] for r in known], 1.5).T)
    predicted = S.predict_groups(rows, ["x", "g"], out)
    assert {"prediction_both_y", "prediction_both_z", "prediction_one_z", "prediction_none_empty"} <= set(predicted.columns)
    with pytest.raises(ValueError, match="label"):
        S.target_groups_models(rows, ["x"], {"g": []})


def test_quantile_lines_leave_their_share_below(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 10, 4000)
    y = 3 + 2 * x + rng.normal(0, 1, 4000) * (0.5 + x)
    frame = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    lines = U.quantile_lines(frame, ["x"], "y", [0.05, 0.5, 0.95])
    for t, (a, b) in lines.coefficients.items():
        assert abs(float((y < a + b * x).mean()) - t) < 0.012
        half = x > 5
        assert abs(float((y < a + b * x)[half].mean()) - t) < 0.03
    assert lines.coefficients[0.05][1] < 1.2 < 2.8 < lines.coefficients[0.95][1]
    with pytest.raises(ValueError, match="no row"):
        U.quantile_lines(frame.limit(0), ["x"], "y", [0.5])


def test_conformal_quantiles_cover_and_follow_the_spread(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 10, 6000)
    y = x + rng.normal(0, 1, 6000) * (0.2 + x)
    rows = [(i // 3, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    frame = spark.createDataFrame([*rows, (None, 1.0, 1.0), (5, None, 1.0), (6, 1.0, None)], "person int, x double, y double")
    model = U.conformal_quantiles(frame.filter("coalesce(person, 0) < 1500"), "person", ["x"], "y", 0.1)
    got = model.predict(frame.filter("person >= 1500 AND x IS NOT NULL")).toPandas()
    assert abs(((got.y >= got.low) & (got.y <= got.high)).mean() - 0.9) < 0.03
    width = got.high - got.low
    assert width[got.x > 8].mean() > 3 * width[got.x < 2].mean()
    held = model.widths.collect()
    assert len(held) == 1 and held[0].n == 900 or held[0].n > 800


def folds(seed=3, n=300):
    rng = random.Random(seed)
    return [(i, i % 4, i % 3, rng.choice([0, 0, 1]), rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(n)] + [(n, None, 1, 0, 1.0, 1.0), (n + 1, 1, 1, 0, None, 1.0), (n + 2, 1, 1, None, 1.0, 1.0)]


def test_no_row_helps_to_make_its_own_deviation(spark):
    frame = spark.createDataFrame(folds(), "id int, o int, i int, g int, x double, y double")
    out = V.cross_fitted_deviation(frame, ["x"], "y", "g", "o", "i", 3.0)
    got = {(r.id, r.held): r for r in out.collect()}
    known = [r for r in folds() if r[1] is not None]
    assert len(got) == 4 * len(known)
    controls = [r for r in known if r[3] == 0 and r[4] is not None]
    raw = {}
    for i, o, inner, g, x, y in known:
        for held in range(4):
            own = [r for r in controls if r[1] != held and (o == held or r[2] != inner)]
            b = ridge([[r[4]] for r in own], [[r[5]] for r in own], 3.0)
            r = got[i, held]
            assert r.role == ("test" if o == held else "train")
            if x is None:
                assert r.deviation is None
                continue
            assert r.deviation == pytest.approx(float(b[0, 0] + b[1, 0] * x - y))
            if r.role == "train" and g == 0:
                raw.setdefault(held, []).append(r.deviation)
    for (_, held), r in got.items():
        if r.deviation is not None:
            assert r.scaled == pytest.approx(r.deviation / np.std(raw[held]))


def test_fold_scores_tell_groups_apart_on_rows_not_seen(spark):
    rng = random.Random(8)
    rows = [(i, i % 4, i % 3, i % 2, (x := rng.gauss(0, 1)), 2 * x + rng.gauss(0, 0.5) - 1.5 * (i % 2)) for i in range(400)]
    frame = spark.createDataFrame(rows, "id int, o int, i int, g int, x double, y double")
    crossed = V.cross_fitted_deviation(frame, ["x"], "y", "g", "o", "i")
    out = V.fold_scores(V.fold_scores(crossed, ["x"], "g", "base"), ["x", "scaled"], "g", "more").filter("role = 'test'").toPandas()
    area = lambda s: np.mean([(a > b) + (a == b) / 2 for a in s[out.g == 1] for b in s[out.g == 0]])
    assert len(out) == 400 and area(out.base) < 0.6 and area(out.more) > 0.9
    one = crossed.withColumn("g", F.lit(1))
    assert V.fold_scores(one, ["x"], "g").filter("score IS NOT NULL").count() == 0
