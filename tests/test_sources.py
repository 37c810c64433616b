"""Sources and sinks: what is written is read, and what is wrong is an error."""

import json
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from concordia.operators import agreement as A
from concordia.operators.models import estimator
from concordia.sources import tables as T


def test_database_reads_all_rows_in_ranges(spark):
    url, props = "jdbc:derby:memory:concordia;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.range(50).select(F.when(F.col("id") > 2, F.col("id")).alias("ID"), (F.col("id") * 2).alias("N"))
    rows.write.jdbc(url, "sdmt", mode="overwrite", properties=props)
    out = T.database(spark, url, "SDMT", "ID", 4, **props)
    assert out.rdd.getNumPartitions() == 4 and out.agg(F.count("*"), F.sum("N")).first() == (50, 2450)
    assert T.database(spark, url, "SDMT", **props).count() == 50


def test_first_source_that_can_be_read(spark, tmp_path):
    (tmp_path / "tmt.csv").write_text("a,b\n1,x\n")
    sources = {"database": lambda: T.database(spark, "jdbc:derby:memory:none", "tmt", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver"), "file": lambda: T.csv(spark, str(tmp_path / "tmt.csv"))}
    assert T.first_of(sources).collect()[0].asDict() == {"a": 1, "b": "x"}
    with pytest.raises(ValueError, match="database: .*; file: "):
        T.first_of(sources | {"file": lambda: T.csv(spark, str(tmp_path / "none.csv"))})


def test_lines_before_the_header(spark, tmp_path):
    path = tmp_path / "clinical.csv"
    path.write_text("Title\nsecond, line\n Código ,age,\nP1, 30 ,\n\nP2,,\n")
    assert [r.asDict() for r in T.skipped_csv(spark, str(path), 2).collect()] == [{"Código": "P1", "age": "30"}, {"Código": "P2", "age": None}]
    with pytest.raises(ValueError, match="no line 10"):
        T.skipped_csv(spark, str(path), 9)
    path.write_text("a,a\n1,2\n")
    with pytest.raises(ValueError, match="repeated"):
        T.skipped_csv(spark, str(path), 0)


def test_fixed_schema(spark, tmp_path):
    path = tmp_path / "fixed.csv"
    path.write_text("id,age\nP1,30\nP2,200\n")
    schema = StructType.fromDDL("person string, age double")
    assert T.fixed_csv(spark, str(path), schema, ["id", "age"]).agg(F.sum("age")).first()[0] == 230
    with pytest.raises(ValueError, match=r"age_domain \(1\)"):
        T.fixed_csv(spark, str(path), schema, ["id", "age"], {"age_domain": F.col("age") > 120, "no_person": F.col("person").isNull()})
    with pytest.raises(ValueError, match="header"):
        T.fixed_csv(spark, str(path), schema, ["id", "years"])


def test_result_tables_and_reports(spark, tmp_path):
    root = str(tmp_path / "results")
    T.append(spark.createDataFrame([("m", 1.0)], "model string, rmse double"), root, "metrics")
    T.append(spark.createDataFrame([("n", 2.0, "x")], "model string, rmse double, note string"), root, "metrics")
    assert sorted(tuple(r) for r in T.results(spark, root, "metrics").select("model", "rmse", "note").collect()) == [("m", 1.0, None), ("n", 2.0, "x")]
    for n in (3, 4):
        T.report({"counts": spark.range(n), "summary": spark.range(1)}, root)
    assert T.results(spark, root, "counts").count() == 4


def test_json_holds_aggregates_only(spark, tmp_path):
    path = str(tmp_path / "out")
    T.json(spark.createDataFrame([("SDMT", 0.5, None)], "outcome string, auc double, p double"), path)
    assert [json.loads(r.value) for r in spark.read.text(path).collect()] == [{"outcome": "SDMT", "auc": 0.5, "p": None}]
    for bad in (math.nan, math.inf):
        with pytest.raises(ValueError, match="finite"):
            T.json(spark.createDataFrame([(bad,)], "auc double"), path)
    with pytest.raises(ValueError, match="identify"):
        T.json(spark.createDataFrame([("P1",)], "person string"), path, ("person",))


def test_models_are_saved_with_their_ranges(spark, tmp_path):
    frame = spark.range(20).select(F.col("id").cast("double").alias("x"), (F.col("id") * 3.0).alias("y"))
    T.save_model(estimator("linear", ["x"], "y").fit(frame), frame, ["x"], str(tmp_path / "m"))
    model, ranges = T.load_model(spark, str(tmp_path / "m"))
    assert model.transform(frame).agg(F.max(F.abs(F.col("prediction") - F.col("y")))).first()[0] < 1e-6
    far = spark.createDataFrame([(30.0,), (5.0,)], "x double")
    assert A.boundaries(far, ranges, ["x"]).select("violations").first()[0] == 1
