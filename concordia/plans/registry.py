"""Where queries and their SQL are kept, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(frame: DataFrame, digits: int = 4) -> DataFrame:
    """Floating-point columns rounded: sums differ in their last digits with the order of rows."""
    return frame.select(*[F.round(f.name, digits).alias(f.name) if f.dataType.simpleString() in ("double", "float") else F.col(f.name) for f in frame.schema.fields])
