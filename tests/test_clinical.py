"""Preparation, gates, folds, ranks, comparisons and refits against plain versions and known values."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from concordia.functions import columns as C
from concordia.operators import agreement as A
from concordia.operators import calibrator as T
from concordia.operators import comparison as G
from concordia.operators import discrimination as D
from concordia.operators import features as X
from concordia.operators import inference as I
from concordia.operators import keys as K
from concordia.operators import preparation as P
from concordia.operators import quality as Q
from concordia.operators import ranking as O
from concordia.operators import resample as R


def test_codes_and_lookup(spark):
    spelled = dict(zip(["1", "primaria", "2", "BACHILLERATO", "grado", "M", "doctorado", " phd ", "3", "U", None], ["Primary", "Primary", "Secondary", "Secondary", "University", "University", "University", "University", None, None, None], strict=True))
    rows = spark.createDataFrame([(k,) for k in spelled], "e string")
    assert {r[0]: r[1] for r in rows.select("e", C.education_band(F.col("e"))).collect()} == spelled
    sexes = {"woman": 1.0, "F": 1.0, "man": 0.0, "Hombre": 0.0, "dona": None, None: None}
    rows = spark.createDataFrame([(k,) for k in sexes], "s string")
    assert {r[0]: r[1] for r in rows.select("s", C.sex_binary(F.col("s"))).collect()} == sexes
    texts = {"  Nivel__Escolarización ": "nivel escolarizacion", "ÅNGSTRÖM\tﬁn": "angstrom fin", "été": "ete", "Ω²": "ω2", None: None}
    rows = spark.createDataFrame([(k,) for k in texts], "t string")
    assert {r[0]: r[1] for r in rows.select("t", C.lookup_text(F.col("t"))).collect()} == texts


def test_ages_gaps_and_bands(spark):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    rows = spark.createDataFrame([(day(0), day(-14610), day(100.5)), (day(0), day(1), day(400)), (day(0), None, day(-365))], "a timestamp, b timestamp, m timestamp")
    got = [tuple(r) for r in rows.select(C.age_at(F.col("a"), F.col("b")), C.visit_gap(F.col("a"), F.col("m"))).collect()]
    assert got == [(14610 / 365.25, -100.5), (None, None), (None, 365.0)]
    rows = spark.createDataFrame([("5", 17.0, 29.0), ("80,5", 17.5, 50.5), ("x", 61.0, -1.0)], "d string, c double, p double")
    got = [tuple(r) for r in rows.select(C.disease_years(F.col("d")), C.cognitive_burden_band(F.col("c")), C.physical_impact_band(F.col("p"))).collect()]
    assert got == [(5.0, "Cog_low", "Phys_low"), (None, "Cog_moderate", "Phys_high"), (None, None, None)]


def test_fatigue_needs_whole_blocks(spark):
    whole = spark.createDataFrame([(10, 8, 6, 0, 1, 2), (0, 1, None, 1, 1, 1)], "numdig1 int, numdig2 int, numdig3 int, numerr1 int, numerr2 int, numerr3 int")
    out = X.fatigue(whole)
    assert len(out.columns) == 6 + 12
    r = out.first().asDict()
    assert r["sdmt_fatigue_correct_slope"] == -2 and r["sdmt_fatigue_error_last_over_first"] is None and r["sdmt_fatigue_accuracy_last_over_first"] == pytest.approx(0.75)
    assert len(X.fatigue(whole.drop("numdig2")).columns) == 5 + 4 and X.fatigue(whole.drop("numdig2", "numerr1")).columns == whole.drop("numdig2", "numerr1").columns


def test_logs_keep_nulls(spark):
    rows = spark.createDataFrame([("train", None, 1.0), ("train", 3.0, -1.0), ("test", -2.0, 5.0)], "split string, t double, e double")
    assert [tuple(r) for r in X.log_transform(rows, ["t", "e"]).select("t", "e").collect()] == [(None, 1.0), (math.log(4.0), -1.0), (0.0, 5.0)]
    assert X.log_candidates(["Flight", "errors", "pace", "n_x"]) == ["Flight", "errors", "n_x"]


def test_preparation(spark):
    assert P.identifier_column(["x", "ID", "Código"]) == "Código" and P.identifier_column(["x", "y"]) == "x"
    assert P.with_person(spark.createDataFrame([(1, " ab-2 ")], "x int, id string")).first()[2:] == ("AB-2", "AB")
    catalogue = spark.createDataFrame([("Edad inclusión", 0), ("SDMT total", 1), ("sdmt", 2)], "col string, pos int")
    hints = spark.createDataFrame([("y", "SDMT", 0), ("age", "edad", 0), ("sex", "sexo", 0)], "role string, hint string, prio int")
    assert {r[0]: r[1] for r in P.column_roles(catalogue, hints, ["y"]).collect()} == {"y": "sdmt", "age": "Edad inclusión", "sex": None}
    with pytest.raises(ValueError, match="sex"):
        P.column_roles(catalogue, hints, ["sex"])
    with pytest.raises(ValueError, match="only 1 rows"):
        P.with_targets(spark.createDataFrame([(1.0,), (None,)], "y double"), ["y"])
    with pytest.raises(ValueError, match="unknown levels"):
        P.fixed_levels(spark.createDataFrame([("a",), ("z",)], "c string"), {"c": ["a", "b"]})
    kept, times = P.select_families(["flight time", "total time", "sex_binary", "other"], ["flight time"])
    assert (kept, times) == (["flight time", "sex_binary"], ["total time"])
    assert P.select_families(["total time", "other"], []) == (["other"], ["total time"])
    assert P.without_demography(["sex_binary", "education_band_M", "clinical_group_EM", "z"]) == ["education_band_M", "z"]
    frame = spark.createDataFrame([(1, 2.0, 3.0, "s")], "a int, sex_binary double, score double, t string")
    assert P.allowed(frame, ["a", "score", "t"], ["score"]) == ["a", "sex_binary"]
    assert P.for_model(spark.createDataFrame([("x",), ("y",)], "target string"), ["y"]).count() == 1 and P.audit_only({"late": ["a", "zz"]}, frame).count() == 1


def test_train_filters_in_order(spark):
    rows = [("train", None, 1.0 if i < 5 else None, 2.0, float(i), 1e-10 * i) for i in range(10)] + [("test", 9.0, 9.0, 9.0, 9.0, 9.0)]
    frame = spark.createDataFrame(rows, "split string, a double, b double, c double, e double, f double")
    got = {r[0]: r[1] for r in P.train_filters(frame, list("abcef")).collect()}
    assert got == {"a": "all_nan_in_train", "b": "high_missing_rate_in_train", "c": "low_unique_values_in_train", "e": "kept", "f": "low_variance_in_train"}
    assert P.apply_filters(frame, P.train_filters(frame, list("abcef")))[0].columns == ["split", "e"]
    assert {r[0]: r[1] for r in P.train_filters(frame, ["e"], least_values=11).collect()} == {"e": "low_unique_values_in_train"}


def test_folds_are_those_of_dealing_one_by_one(spark):
    rng = random.Random(4)
    for _ in range(300):
        loads, size, people = [rng.randrange(60) for _ in range(rng.randint(2, 6))], rng.randint(1, 9), rng.randrange(50)
        own = list(loads)
        for _ in range(people):
            own[own.index(min(own))] += size
        assert [x + size * n for x, n in zip(loads, R.shares(loads, size, people), strict=True)] == own
    rows = spark.createDataFrame([(p,) for p in range(3) for _ in range(p + 1)], "p int")
    assert R.balanced_folds(rows, "p", 5).select("fold").distinct().count() == 3 and R.folds(rows, "p", 5).select("fold").distinct().count() == 3
    with pytest.raises(ValueError):
        R.folds(rows, "p", 1)


def test_order_statistics_of_any_distribution(spark):
    rng = random.Random(7)
    values = {"narrow": [1000 + rng.random() for _ in range(200)], "long": [math.exp(rng.gauss(0, 9)) * rng.choice([-1, 1]) for _ in range(201)], "ties": [float(rng.randrange(4)) for _ in range(90)], "one": [5.0], "none": [float("nan")]}
    rows = spark.createDataFrame([(g, v) for g, some in values.items() for v in some] + [(None, 2.0), (None, 4.0), ("ties", None)], "g string, v double").repartition(3)
    got = {r[0]: r[1] for r in O.medians(O.counted(rows, F.col("v"), "g"), "g").collect()}
    assert got == {None: 3.0} | {g: pytest.approx(float(np.median(some))) for g, some in values.items() if g != "none"}
    ranks = {(r.g, r.v): r["rank"] for r in A.ranks(rows.filter("g = 'ties' OR g = 'long'"), "v", "g").collect()}
    for g in ("ties", "long"):
        for v in values[g]:
            below, same = sum(x < v for x in values[g]), values[g].count(v)
            assert ranks[g, v] == below + (same + 1) / 2


def test_nearest_visits_and_retests(spark):
    rng = random.Random(9)
    start = dt.datetime(2024, 1, 1)
    left = [(i, rng.choice("ab"), start + dt.timedelta(hours=rng.randrange(3000))) for i in range(60)] + [(60, None, start), (61, "a", None), (62, "zz", start)]
    right = [(rng.choice("ab"), start + dt.timedelta(hours=rng.randrange(3000)), float(i)) for i in range(25)] + [(None, start, 1.0), ("a", None, 2.0)]
    out = K.nearest(spark.createDataFrame(left, "i int, k string, at timestamp"), spark.createDataFrame(right, "k string, seen timestamp, v double"), "k", "at", "seen", 5)
    assert out.columns == ["i", "k", "at", "seen", "v", "delta_days"]
    got = {r.i: (r.seen, r.v) for r in out.collect()}
    assert len(got) == 63
    for i, k, at in left:
        near = sorted((abs(s - at), s, v) for key, s, v in right if key is not None and key == k and s is not None and at is not None and abs(s - at) <= dt.timedelta(days=5))
        assert got[i] in [(s, v) for gap, s, v in near if (gap, s) == near[0][:2]] if near else got[i] == (None, None)
    visits = spark.createDataFrame(right, "k string, at timestamp, v double")
    pairs = {(r.k, r.at): (r.again, r.change) for r in K.retest(visits, "k", "at", "v").collect()}
    for k, at, v in right:
        if sum(x[:2] == (k, at) for x in right) > 1:
            continue  # two visits at one time
        later = sorted((s, w) for key, s, w in right if k is not None and key == k and at and s and dt.timedelta(days=14) <= s - at <= dt.timedelta(days=28))
        assert pairs.get((k, at)) == ((later[0][0], later[0][1] - v) if later else None)


def test_exclusions_and_disjointness(spark):
    rows = spark.createDataFrame([(k,) for k in range(6)], "k int")
    log = {r.k: r.reason for r in K.exclusions(rows, "k", {"first": rows.filter("k > 1"), "second": rows.filter("k > 2")}).collect()}
    assert log == {0: "first", 1: "first", 2: "second"}
    K.disjoint(rows.filter("k < 3"), rows.filter("k >= 3"), "k")
    with pytest.raises(ValueError, match="1 values"):
        K.disjoint(rows.filter("k < 3"), rows.filter("k >= 2"), "k")


def test_comparison_table(spark):
    rng = random.Random(5)
    rows = [(i % 2, 3.0 + i % 2 + rng.gauss(0, 1), float(i % 7), rng.gauss(0, 1) if i < 12 else None) for i in range(40)]
    frame = spark.createDataFrame(rows, "g int, a double, x double, few double")
    got = {r.measure: r for r in G.comparison_table(frame, "g", [("T", "one", "a"), ("T", "gone", "zz"), ("T", "few", "few")], ["x", "nothing"]).collect()}
    assert got["gone"].status == "column not found" and got["gone"].n1 is None and got["gone"].q is None
    a1, a0 = ([r[1] for r in rows if r[0] == g] for g in (1, 0))
    se = np.var(a1, ddof=1) / 20 + np.var(a0, ddof=1) / 20
    assert got["one"].t == pytest.approx((np.mean(a1) - np.mean(a0)) / math.sqrt(se)) and got["one"].median1 == pytest.approx(np.median(a1))
    assert got["one"].welch_p == pytest.approx(I.t_two_sided(got["one"].t, got["one"].df)) and 0 < got["one"].mann_whitney_p < 1
    f1, f0 = ([r[3] for r in rows if r[0] == g and r[3] is not None] for g in (1, 0))
    u = sum((x > y) + 0.5 * (x == y) for x in f1 for y in f0)
    assert got["few"].u == u and got["few"].mann_whitney_p == pytest.approx(I.mann_whitney_exact(u, 6, 6))
    effect = {r.term: r for r in I.linear_effects(frame, "a", ["g", "x"], "normal").collect()}["g"]
    assert got["one"].effect == pytest.approx(effect.estimate) and got["one"].adjusted_p == pytest.approx(effect.p) and got["one"].adjusted_n == 40
    assert got["one"].q == pytest.approx(min(1.0, min(2 * min(got["one"].adjusted_p, got["few"].adjusted_p), max(got["one"].adjusted_p, got["few"].adjusted_p))) if got["one"].adjusted_p < got["few"].adjusted_p else max(got["one"].adjusted_p, got["few"].adjusted_p))
    means = G.stratum_means(spark.createDataFrame([("a", "b", float(i)) for i in range(6)], "k string, l string, y double"), spark.createDataFrame([("a", "b"), ("a", "z"), ("q", "z")], "k string, l string"), "y", ["k", "l"])
    assert [r.prediction for r in means.collect()] == [2.5, 2.5, 2.5]


def test_calibrators(spark):
    rng = random.Random(6)
    rows = [(i, x, z, 2 * x - z + rng.gauss(0, 0.1), i % 3, float(max(0, round(x)))) for i in range(120) for x, z in [(rng.gauss(0, 1), rng.gauss(3, 2))]]
    frame = spark.createDataFrame(rows, "i int, x double, `z time` double, y double, fold int, errors double")
    for name, options in (("ridge", {}), ("gam", {}), ("linear", {}), ("ensemble", {"fold": "fold", "options": {"rf": {"numTrees": 3, "maxDepth": 3}, "boosted": {"maxIter": 2}}})):
        model = T.train(frame, name, ["x", "z time"], "y", **options)
        out = model.predict(frame.select("y", "z time", "x")).toPandas()
        assert ((out.prediction - out.y) ** 2).mean() < 0.3 * out.y.var() and "_z0" not in out.columns
    counts = T.train(frame, "error_classifier", ["x", "z time"], "errors", numTrees=5).predict(frame)
    assert set(counts.toPandas().prediction) <= {0.0, 1.0, 2.0, 3.0, 4.0}
    far = spark.createDataFrame([(99.0, 3.0), (0.0, 3.0)], "x double, `z time` double")
    assert [(r.feature, r.violations) for r in model.outside(far).collect()] == [("x", 1)]
    with pytest.raises(ValueError, match="missing: x"):
        model.predict(far.drop("x"))
    for bad, message in ((frame.limit(0), "no rows"), (frame.withColumn("x", F.lit(None).cast("double")), "nulls in x")):
        with pytest.raises(ValueError, match=message):
            T.train(bad, "ridge", ["x"], "y")
    with pytest.raises(ValueError, match="ensemble, error_classifier, gam"):
        T.train(frame, "svm", ["x"], "y")
    with pytest.raises(ValueError, match="folds"):
        T.train(frame, "ensemble", ["x"], "y")


def _area(score, label):
    return np.mean([(a > b) + 0.5 * (a == b) for a in score[label == 1] for b in score[label == 0]])


def test_refitted_discrimination(spark):
    rng = np.random.default_rng(3)
    n = 90
    g = np.arange(n) % 2
    x, y = rng.normal(size=n) + 0.3 * g, rng.normal(size=n) - 0.8 * g
    frame = spark.createDataFrame([(f"p{i}", int(g[i]), float(y[i]), float(x[i])) for i in range(n)], "p string, g int, y double, x double")
    draws = D.class_bootstrap(frame, "p", "g", 2).unionByName(D.all_seeds(frame, "p", "g", [7])).unionByName(frame.limit(6).select(F.lit(9).alias("replicate"), "p", "g", F.lit(1).cast("long").alias("w")))
    got = {r.replicate: r for r in D.discrimination(frame, "p", "g", "y", ["x"], draws).collect()}
    assert sorted(got) == [0, 1, 7]
    weights = {(r.replicate, r.p): r.w for r in draws.collect()}
    assert sum(w for (b, _), w in weights.items() if b == 0) == n
    ranked = {(r.replicate, r.p): (r["_rank"] - 1) % 5 for r in R._ranked(draws, [R.draw(F.lit(42) + F.col("replicate"), F.col("p")), F.col("p")], "replicate", "g").collect()}
    for b in got:
        who = [i for i in range(n) for _ in range(weights.get((b, f"p{i}"), 0))]
        fold = np.array([ranked[b, f"p{i}"] for i in who])
        t, scores = g[who], {m: np.zeros(len(who)) for m in ("base", "more", "deviation")}
        for f in range(5):
            tr, te = fold != f, fold == f
            for m, columns in (("base", [x]), ("more", [x, y])):
                raw = np.column_stack([c[who] for c in columns])
                z = np.column_stack([np.ones(len(who)), (raw - raw[tr].mean(0)) / raw[tr].std(0)])
                w = np.zeros(z.shape[1])
                for _ in range(8):
                    p = 1 / (1 + np.exp(-z[tr] @ w))
                    h = (z[tr].T * (p * (1 - p))) @ z[tr] + np.diag([0.0] + [1.0] * (len(w) - 1))
                    w = w + np.linalg.solve(h, z[tr].T @ (t[tr] - p) - np.append(0, w[1:]))
                scores[m][te] = z[te] @ w
            control = tr & (t == 0)
            mean, sd = x[who][control].mean(), x[who][control].std()
            z = (x[who] - mean) / sd
            slope = (z[control] * (y[who][control] - y[who][control].mean())).sum() / ((z[control] ** 2).sum() + 10)
            scores["deviation"][te] = y[who][control].mean() + slope * z[te] - y[who][te]
        for m in scores:
            assert got[b][f"auc_{m}"] == pytest.approx(_area(scores[m], t), abs=1e-6)
        assert got[b].increment == pytest.approx(got[b].auc_more - got[b].auc_base)
    summary = {r.metric: r for r in R.replicate_summary(D.discrimination(frame, "p", "g", "y", ["x"], D.class_bootstrap(frame, "p", "g", 3)), ["auc_base", "increment"], 5).collect()}
    assert summary["auc_base"].requested == 5 and summary["auc_base"].valid == 3


def test_conformal_gates(spark):
    rows = spark.createDataFrame([(i // 4, float(i)) for i in range(40)], "p int, y double")

    def fit(some):
        mean = some.agg(F.avg("y")).first()[0]
        return lambda other: other.withColumn("prediction", F.lit(mean))

    model, widths = R.split_conformal(rows, "p", fit, "y")
    assert widths.first().q > 0 and R.with_interval(model(rows), widths).filter("low < high").count() == 40
    model, widths = R.split_conformal(rows.filter("p < 3"), "p", fit, "y")
    assert widths is None and R.with_interval(model(rows), widths).filter("low IS NULL").count() == 40


def test_fingerprints_and_sheet_bodies(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    assert Q.fingerprint(rows).first() == Q.fingerprint(rows.orderBy(F.desc("k"))).first() != Q.fingerprint(rows.withColumn("v", F.lit("a"))).first()
    (tmp_path / "x.csv").write_bytes(b"hello")
    assert Q.file_fingerprints(spark, str(tmp_path)).first().sha256 == "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"
    grid = spark.createDataFrame([("s", 0, 0, "title"), ("s", 1, 0, " Código "), ("s", 1, 1, "age"), ("s", 2, 0, "P1"), ("s", 2, 1, "40"), ("s", 3, 0, "P2")], "sheet string, row_idx int, col_idx int, value string")
    found = Q.headers(grid, "Código", 2)
    assert found.first().header == 1
    assert sorted(tuple(r) for r in Q.bodies(grid, found, ["Código", "age"]).collect()) == [("s", 2, "P1", "40"), ("s", 3, "P2", None)]


def test_intervals_without_any(spark):
    rows = spark.createDataFrame([(1.0, None, None)], "y double, a double, b double")
    assert A.interval_metrics(rows, "y", "a", "b", 0.1).first().asDict() == {"pi_alpha": 0.1, "pi_coverage": None, "pi_miscoverage": None, "pi_mean_width": None, "pi_median_width": None}
