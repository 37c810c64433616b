"""Saved models, sheets read into grids, checked writes, one-hot rules, names in lookup form, retests, folds of mixed classes."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from concordia.functions.columns import lookup_name
from concordia.operators import calibrator as T
from concordia.operators import features as X
from concordia.operators import keys as K
from concordia.operators import preparation as P
from concordia.operators import resample as R
from concordia.sources import saved, tables


@pytest.fixture(scope="module")
def curve(spark):
    rng = np.random.default_rng(5)
    rows = [(float(v), float(a), float(np.sin(v) + a), int(abs(v)), i % 3) for i, (v, a) in enumerate(zip(rng.normal(0, 2, 150), rng.normal(0, 1, 150), strict=True))]
    return spark.createDataFrame(rows, "x double, `a b` double, y double, errors int, fold int").cache()


SMALL = {"rf": {"numTrees": 5, "maxDepth": 4}, "boosted": {"maxIter": 3}}


@pytest.mark.parametrize(("name", "label", "options"), [("ridge", "y", {}), ("gam", "y", {}), ("linear", "y", {}), ("rf", "y", SMALL["rf"]), ("ensemble", "y", {"fold": "fold", "options": SMALL}), ("error_classifier", "errors", SMALL["rf"])])
def test_saved_calibrators_predict_alike(spark, curve, tmp_path, name, label, options):
    model = T.train(curve, name, ["x", "a b"], label, **options)
    saved.save(spark, model, f"file://{tmp_path}/kept")
    saved.save(spark, model, f"file://{tmp_path}/kept")  # in place of the first
    again = saved.load(spark, f"file://{tmp_path}/kept")
    assert (again.name, again.features, again.label, again.rows, again.ranges, again.scale) == (model.name, model.features, model.label, model.rows, model.ranges, model.scale)
    a, b = (sorted(r.prediction for r in m.predict(curve.select("a b", "x")).collect()) for m in (model, again))
    assert a == b and len(a) == 150


def test_one_class_of_counts_is_saved_too(spark, curve, tmp_path):
    model = T.train(curve.withColumn("errors", F.lit(2)), "error_classifier", ["x"], "errors")
    saved.save(spark, model, f"{tmp_path}/one")
    assert {r.prediction for r in saved.load(spark, f"{tmp_path}/one").predict(curve).collect()} == {2.0}


def test_sheets_become_grids_and_records(spark, tmp_path):
    (tmp_path / "one.csv").write_text('notes,,\nCódigo,Edad,Nota\np1,40,"two\nlines, quoted"\n\np2,,x\n', encoding="utf-8")
    (tmp_path / "two.csv").write_text("﻿Código,Nota,Edad\np3,y,50\n", encoding="utf-8")
    (tmp_path / "empty.csv").write_text("")
    cells = {(r.sheet, r.row_idx, r.col_idx): r.value for r in tables.grid(spark, f"file://{tmp_path}/*.csv").collect()}
    assert cells["one", 0, 0] == "notes" and cells["one", 0, 1] is None and cells["one", 2, 2] == "two\nlines, quoted" and cells["two", 0, 0] == "Código"
    got = sorted(tuple(r) for r in tables.sheet_records(spark, f"file://{tmp_path}/*.csv", ["Código", "Edad", "Nota"], "Código").collect())
    assert got == [("one", 2, "p1", "40", "two\nlines, quoted"), ("one", 4, "p2", None, "x"), ("two", 1, "p3", "50", "y")]


def test_a_broken_rule_stops_the_write(spark, tmp_path):
    frame, rules = spark.range(100).withColumn("v", F.col("id") % 7), {"large": F.col("v") > 6, "none": F.col("v").isNull()}
    path = f"file://{tmp_path}/table"
    assert tables.checked(frame, path, rules) == {"large": 0, "none": 0}
    with pytest.raises(ValueError, match=r"large \(1\)"):
        tables.checked(frame.withColumn("v", F.when(F.col("id") == 3, 9).otherwise(F.col("v"))), path, rules)
    assert spark.read.parquet(path).agg(F.max("v")).first()[0] == 6
    assert tables.checked(frame.limit(0), path, rules) == {"large": 0, "none": 0} and spark.read.parquet(path).count() == 0
    assert [p.name for p in tmp_path.iterdir()] == ["table"]


def test_one_hot_takes_text_columns_with_few_levels(spark):
    rows = [(i, "ab"[i % 2], f"v{i}", "xyz"[i % 3] if i % 4 else None, i % 2 == 0, "f" if i % 2 else "m", "one", f"d{i % 2}", float(i)) for i in range(30)]
    frame = spark.createDataFrame(rows, "n int, arm string, many string, `band x` string, flag boolean, Sexo string, same string, visit_date string, v double")
    out = X.one_hot(frame)
    assert set(out.columns) - set(frame.columns) == {"arm_a", "arm_b", "band x_x", "band x_y", "band x_z"}
    r = out.filter("n = 4").first()
    assert (r.arm_a, r.arm_b, r["band x_x"], r["band x_y"], r["band x_z"], r.flag) == (1.0, 0.0, 0.0, 0.0, 0.0, 1.0)
    assert set(X.one_hot(frame, ["arm", "flag", "Sexo"], exclude=("flag",)).columns) - set(frame.columns) == {"arm_a", "arm_b"}
    assert dict(X.one_hot(frame, ["arm"]).dtypes)["flag"] == "boolean"
    assert X.one_hot(frame.limit(0)).columns == frame.columns


def test_names_are_compared_in_lookup_form():
    assert lookup_name("  Presión__Mean \t x") == "presion mean x" and lookup_name("ﬁnger_Lift") == "finger lift"
    columns = ["inside_circle_time", "average_time_inside_circles", "average_rate_inside_circles", "Presión mean", "duración_time", "Number__Lifts"]
    found = P.families(columns)
    assert found["inside_circle_time"] == columns[:3]  # the first patterns look for "in" anywhere
    assert found["inside_circle_rate"] == ["average_rate_inside_circles"] and found["pressure_mean"] == ["Presión mean"] and found["finger_lift_rate"] == ["Number__Lifts"]
    assert P.matching(columns, P.WHOLE_TIMES) == ["duración_time"]
    assert X.log_candidates(["Duración", "x", "Érrores"]) == ["Duración", "Érrores"]


def test_sources_that_share_no_key_are_an_error(spark):
    a, b = spark.createDataFrame([(1, 2)], "k int, v int"), spark.createDataFrame([(2, 2), (None, 1)], "k int, v int")
    with pytest.raises(ValueError, match="no k"):
        K.paired(a, b, "k")
    assert K.paired(a, b.union(a), "k").columns == ["k", "v", "v_clinical"]


def test_retests_against_all_pairs(spark):
    rng, day = random.Random(3), 86_400
    rows = [(rng.choice("ab"), day * rng.randint(0, 90) + rng.choice([0, 0, 7]), float(rng.randint(0, 9))) for _ in range(150)] + [("c", 0, 1.0), ("c", 14 * day, 2.0), ("c", 28 * day, 3.0), (None, 5, 1.0), ("d", None, 1.0)]
    frame = spark.createDataFrame(rows, "k string, s long, v double").withColumn("at", F.timestamp_seconds("s"))
    got = sorted((r.k, r.at.timestamp(), r.again.timestamp(), r.change) for r in K.retest(frame, "k", "at", "v").collect())
    want = []
    for k, s, v in rows:
        later = sorted((u, w) for q, u, w in rows if k is not None and s is not None and q == k and u is not None and 14 * day <= u - s <= 28 * day)
        want += [(k, float(s), float(later[0][0]), later[0][1] - v)] if later else []
    offset = {round(a[1] - b[1]) for a, b in zip(got, sorted(want), strict=True)}
    assert len(offset) == 1  # the time zone of timestamps read back
    assert [(a[0], a[2] - a[1], a[3]) for a in got] == [(b[0], b[2] - b[1], b[3]) for b in sorted(want)]


@pytest.mark.parametrize("most", [10_000, 3])
def test_folds_of_people_of_mixed_classes(spark, monkeypatch, most):
    monkeypatch.setattr(R, "MANY", most)
    rng = random.Random(9)
    rows = [(i, rng.choice(["u", "v", "v", None]) if i % 3 else "u") for i in range(400) for _ in range(rng.randint(1, 6))] + [(None, "u")]
    out = R.mixed_class_folds(spark.createDataFrame(rows, "p int, c string").repartition(3), "p", "c").toPandas()
    assert len(out) == len(rows) - 1 and out.groupby("p").fold.nunique().max() == 1
    for c, own in out.assign(c=out.c.fillna("-")).groupby("c"):
        share = own.fold.value_counts(normalize=True)
        assert len(share) == 5 and share.max() < 0.24 and share.min() > 0.16, c
    assert out.groupby("fold").p.nunique().min() >= 70
    few = R.mixed_class_folds(spark.createDataFrame([(1, "u"), (2, "v"), (2, "u")], "p int, c string"), "p", "c").collect()
    assert len({r.fold for r in few}) == 2
    assert all(a == b for a, b in itertools.pairwise(sorted({(r.p, r.fold) for r in few})) if a[0] == b[0])


def test_days_are_read_day_first(spark):
    from concordia.operators.quality import day_first

    texts = {"3/4/2021": "2021-04-03", "03-04-2021": "2021-04-03", " 3.4.2021": "2021-04-03", "2021-4-3": "2021-04-03", "2021/04/03": "2021-04-03", "3 Apr 2021": "2021-04-03", "3/25/2020": "2020-03-25", "3/4/21": "2021-04-03"}
    times = {"3/4/2021 9:05": "2021-04-03 09:05:00", "2021-04-03T10:20:30": "2021-04-03 10:20:30", "2021-04-03 10:20:30": "2021-04-03 10:20:30", "3/25/2020 1:00:00": "2020-03-25 01:00:00"}
    rows = [(t, f"{w} 00:00:00"[:19] if ":" not in w else w) for t, w in {**texts, **times}.items()] + [("40/1/2021", None), ("x", None), (None, None), ("2021", None)]
    out = spark.createDataFrame(rows, "t string, want string").withColumn("got", F.date_format(day_first(F.col("t")), "yyyy-MM-dd HH:mm:ss"))
    assert [(r.t, r.got) for r in out.collect() if r.got != r.want] == []


def test_sums_of_too_many_groups_are_refused(spark, monkeypatch):
    from concordia.operators import inference as I

    monkeypatch.setattr(I, "MANY", 3)
    frame = spark.range(20).select(F.col("id").cast("double").alias("x"), (F.col("id") % 5).alias("g"))
    with pytest.raises(ValueError, match="over 3 groups"):
        I.gram(frame, ["x"], "g")
    assert len(I.gram(frame.filter("g < 3"), ["x"], "g")) == 3
