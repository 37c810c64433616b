"""Sources and sinks: database tables, files with lines before the header, fixed schemas, result tables, JSON, models."""

from __future__ import annotations

import csv as lines_of
import io
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.ml import PipelineModel
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.quality import bodies, expect, headers


def database(spark: SparkSession, url: str, table: str, column: str | None = None, partitions: int = 8, **properties: str) -> DataFrame:
    """A table of a database, its name in lower case; with a whole-number column, read in that many ranges of it at once.

    The bounds of the ranges come from one aggregate in the database; rows with a null there are read too. The
    database's driver must be on Spark's class path.
    """
    name = table.lower()
    if column is None:
        return spark.read.jdbc(url, name, properties=properties)
    low, high = spark.read.jdbc(url, f"(SELECT min({column}) AS lo, max({column}) AS hi FROM {name}) bounds", properties=properties).first()
    if low is None:
        return spark.read.jdbc(url, name, properties=properties)
    return spark.read.jdbc(url, name, column=column, lowerBound=int(low), upperBound=int(high) + 1, numPartitions=partitions, properties=properties)


def first_of(sources: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """The first source that can be read; if none can, an error that names each with its reason."""
    reasons = []
    for name, read in sources.items():
        try:
            return read()
        except (PySparkException, Py4JJavaError) as e:
            reasons.append(f"{name}: {str(e).splitlines()[0]}")
    raise ValueError(f"no source can be read ({'; '.join(reasons)})")


def csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=True)


def skipped_csv(spark: SparkSession, path: str, skip: int, separator: str = ",") -> DataFrame:
    """One CSV file whose header stands after `skip` lines; all columns are text, empty ones null, and records are lines.

    Line numbers hold from the file's start, which the first partition reads; it must hold the first lines.
    """
    lines = spark.read.text(path).withColumn("_at", F.monotonically_increasing_id())
    if len(lines.inputFiles()) != 1:
        raise ValueError(f"{path} isn't one file")
    head = lines.filter(F.col("_at") == skip).select("value").first()
    if head is None:
        raise ValueError(f"{path} has no line {skip + 1}")
    options = {"sep": separator, "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    width = head.value.count(separator) + 1
    parts = spark.createDataFrame([head], "value string").select(F.from_csv("value", ", ".join(f"c{k} string" for k in range(width)), options).alias("c")).first().c
    names = [n for n in parts if n is not None]
    if len(set(names)) != len(names) or None in parts[: len(names)]:
        raise ValueError(f"the header {head.value!r} has empty or repeated names")
    schema = ", ".join(f"`{n}` string" for n in names)
    return lines.filter((F.col("_at") > skip) & (F.trim("value") != "")).select(F.from_csv("value", schema, options).alias("c")).select("c.*")


def grid(spark: SparkSession, path: str, separator: str = ",", encoding: str = "utf-8") -> DataFrame:
    """(sheet, row_idx, col_idx, value) of every cell of the CSV files that path names, a file being a sheet, its name without suffix.

    A file is a task's work and held whole by it, so records may span lines and quoted cells hold separators; files of
    any store that Spark reads can be taken. Blank cells are null, row numbers are those of records, empty ones counted.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def cells(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                sheet = name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                rows = lines_of.reader(io.StringIO(content.decode(encoding).removeprefix("\ufeff"), newline=""), delimiter=separator)
                found = [(sheet, r, c, v if v.strip() else None) for r, row in enumerate(rows) for c, v in enumerate(row)]
                yield pd.DataFrame(found, columns=["sheet", "row_idx", "col_idx", "value"])

    return files.mapInPandas(cells, "sheet string, row_idx int, col_idx int, value string")


def sheet_records(spark: SparkSession, path: str, columns: list[str], mark: str, within: int = 0, separator: str = ",") -> DataFrame:
    """(sheet, row_idx, columns as text) of the records below each sheet's header, which is the first row near its top with the mark."""
    cells = grid(spark, path, separator)
    return bodies(cells, headers(cells, mark, within), columns)


def checked(frame: DataFrame, path: str, rules: dict[str, Column]) -> dict[str, int]:
    """Writes frame to path, in place of an earlier table, unless a row breaks a rule; then nothing changes there and it is an error.

    The rows are counted while they are written, to a place beside path, and the written table is moved when no rule is
    broken, so the expectations cost no scan of their own. Returns how many rows break each rule (none).
    """
    spark, seen, place = frame.sparkSession, Observation(), f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    counts = [F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).alias(f"r{k}") for k, c in enumerate(rules.values())]
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    try:
        frame.observe(seen, F.count("*").alias("rows"), *counts).write.parquet(place)
        got = seen.get
        found = {name: int(got[f"r{k}"]) for k, name in enumerate(rules)}
        if broken := [f"{name} ({n})" for name, n in found.items() if n]:
            raise ValueError(f"rows break {', '.join(sorted(broken))}")
        files.delete(hadoop(path), True)
        if not files.rename(hadoop(place), hadoop(path)):
            raise OSError(f"{place} can't be moved to {path}")
    finally:
        files.delete(hadoop(place), True)
    return found


def fixed_csv(spark: SparkSession, path: str, schema: StructType, labels: list[str], rules: dict[str, Column] | None = None) -> DataFrame:
    """A CSV file of known columns by place: its header must read `labels`, its values must parse, and no rule be broken."""
    head = spark.read.csv(path, header=False).first()
    if head is None or [*map(str, head)] != labels:
        raise ValueError(f"the header of {path} is {None if head is None else list(head)}, not {labels}")
    frame = spark.read.csv(path, schema=schema, header=True, enforceSchema=True, mode="FAILFAST")
    if rules:
        broken = [f"{r.rule} ({r.violations})" for r in expect(frame, rules).filter("violations > 0").collect()]
        if broken:
            raise ValueError(f"{path} breaks {', '.join(sorted(broken))}")
    return frame


def append(frame: DataFrame, root: str, name: str) -> None:
    """Adds rows to a result table below root, which is made if missing; later columns may be new."""
    frame.write.mode("append").parquet(f"{root}/{name}")


def results(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(f"{root}/{name}")


def report(tables: dict[str, DataFrame], root: str) -> None:
    """Each table below root under its name, in place of an earlier one."""
    for name, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{root}/{name}")


def json(frame: DataFrame, path: str, identifiers: tuple[str, ...] = ()) -> None:
    """Aggregates as lines of JSON; columns that identify people, and values that aren't finite, are errors."""
    held = [c for c in frame.columns if c in identifiers]
    if held:
        raise ValueError(f"{', '.join(held)} identify people")
    numbers = [f.name for f in frame.schema if f.dataType.simpleString() in ("double", "float")]
    if numbers:
        bad = frame.agg(*[F.count_if(F.isnan(c) | (F.abs(c) == float("inf"))).alias(c) for c in numbers]).first()
        if any(bad):
            raise ValueError(f"values of {', '.join(c for c in numbers if bad[c])} aren't finite")
    frame.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def ranges(frame: DataFrame, features: list[str]) -> DataFrame:
    """(feature, lo, hi) from one aggregate."""
    each = F.array(*[F.struct(F.lit(c).alias("feature"), F.min(F.col(c).cast("double")).alias("lo"), F.max(F.col(c).cast("double")).alias("hi")) for c in features])
    return frame.agg(each.alias("all")).select(F.inline("all"))


def save_model(model: PipelineModel, train: DataFrame, features: list[str], path: str) -> None:
    """A fitted pipeline and, beside it, the training range of each feature."""
    model.write().overwrite().save(f"{path}/model")
    ranges(train, features).write.mode("overwrite").parquet(f"{path}/ranges")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, DataFrame]:
    return PipelineModel.load(f"{path}/model"), spark.read.parquet(f"{path}/ranges")
