"""Splits by a cut among people, and joins with small tables, that leave rows where they lie."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from concordia.operators import comparison as G
from concordia.operators import learning as L
from concordia.operators import quantiles as U
from concordia.operators import resample as R


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["int", "string", "double"])
@pytest.mark.parametrize("share", [0.0, 0.2, 0.37, 1.0])
def test_split_is_by_rank_of_the_hash(spark, kind, share):
    frame = spark.createDataFrame([(i % 83, float(i)) for i in range(500)] + [(None, 1.0)], "p int, y double").repartition(3)
    frame = frame.withColumn("p", (F.col("p") if kind == "string" else F.col("p") - 40).cast(kind))
    people = [r[0] for r in frame.select("p").dropna().distinct().collect()]
    order = sorted(people, key=lambda p: (int(hashlib.md5(f"7:{p}".encode()).hexdigest()[:8], 16), p))
    out = R.split(frame, "p", share, 7)
    assert out.columns == ["p", "y", "split"] and out.count() == 500
    assert {r[0] for r in out.filter("split = 'test'").select("p").collect()} == set(order[: int(np.ceil(83 * share))])
    assert R.split(frame.limit(0), "p", share, 7).count() == 0


def test_split_takes_both_zeros_as_one_person(spark):
    frame = spark.createDataFrame([(0.0, 1), (-0.0, 2), *[(float(i), i) for i in range(3, 30)]], "p double, y int")
    out = R.split(frame, "p", 0.5)
    assert out.filter("y < 3").select("split").distinct().count() == 1 and out.filter("split = 'test'").select(F.expr("p + 0D")).distinct().count() == 14


def test_split_moves_no_rows(spark):
    out = plan(R.split(spark.range(100).withColumnRenamed("id", "p"), "p"))
    assert "Exchange" not in out and "Join" not in out and "Window" not in out


def test_intervals_join_widths_where_rows_lie(spark):
    spark.catalog.clearCache()
    rows = spark.createDataFrame([(i // 3, float(i % 7), float(i % 11), "ab"[i % 2]) for i in range(600)], "p int, x double, y double, k string")
    model, widths = R.split_conformal(rows, "p", lambda own: lambda other: other.withColumn("prediction", F.lit(5.0)), "y", 0.1, 0.2, 42, "k")
    out = plan(R.with_interval(model(rows), widths, "k"))
    assert "SortMergeJoin" not in out and "BroadcastHashJoin" in out
    lines = U.conformal_quantiles(rows, "p", ["x"], "y", by=("k",))
    assert {r.k for r in lines.widths.collect()} == {"a", "b"} and "SortMergeJoin" not in plan(lines.predict(rows))
    assert "Window" not in plan(lines.widths) and not spark._jsparkSession.sharedState().cacheManager().numCachedEntries()


def test_adjusted_measures_are_not_gathered_by_measure(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(G, "linear_effects", lambda rows, *rest, **more: seen.append(plan(rows)) or spark.createDataFrame([], "measure string, term string, n long, estimate double, se double, p double"))
    rows = spark.createDataFrame([(i % 2, float(i), float(i % 5), float(i) if i < 4 else None) for i in range(40)], "g int, a double, x double, few double")
    long = G.long_form(rows, "g", {"one": "a", "few": "few"}, ["x"])
    G.adjusted(long, ["x"])
    assert "Join" not in seen[0] and "Exchange" not in seen[0]


def test_elimination_keeps_only_columns_it_reads(spark, monkeypatch):
    seen, plain = [], L.estimator

    class Seen:
        def __init__(self, *names, **options):
            self.own = plain(*names, **options)

        def fit(self, rows):
            seen.append(rows.columns)
            return self.own.fit(rows)

    monkeypatch.setattr(L, "estimator", Seen)
    rows = spark.createDataFrame([(float(i), float(i % 3), float(i % 5), float(i % 7), "wide") for i in range(60)], "a double, b double, c double, d double, other string")
    left = L.eliminate(rows.withColumn("y", F.col("a")), ["a", "b", "c", "d"], "y", most=2, least=2, step=0.5, trees=3, depth=3)
    assert "a" in left and len(left) == 2 and seen[0] == ["a", "b", "c", "d", "y"]
