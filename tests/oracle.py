"""Runs registered queries against their SQL: python tests/oracle.py [sf_dir] [name...]."""

from __future__ import annotations

import os
import sys
import traceback

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def same(a: pd.DataFrame, b: pd.DataFrame) -> str:
    """What differs, or nothing."""
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} {sorted(b.columns)}"
    if len(a) != len(b):
        return f"rows {len(a)} {len(b)}"
    key = lambda f: sorted(map(tuple, f[sorted(f.columns)].map(lambda x: f"{x:.6g}" if isinstance(x, float) else str(x)).replace({"nan": "None", "NaT": "None", "<NA>": "None"}).values.tolist()))
    x, y = key(a), key(b)
    bad = [(p, q) for p, q in zip(x, y, strict=True) if p != q]
    return f"{len(bad)} rows differ, as {bad[0]}" if bad else ""


if __name__ == "__main__":
    import time

    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    con, names = duck(sf), sys.argv[2:] or [n for n in e.queries() if not n.startswith(("op", "pipeline"))]
    for n in names:
        t = time.time()
        try:
            a = e.queries()[n](spark, sf).toPandas()
            said = same(a, con.sql(e.oracle_sql()[n]).df()) if n in e.oracle_sql() else f"no SQL, {len(a)} rows"
        except Exception:
            said = traceback.format_exc()[-700:]
        print(n, f"{time.time() - t:.1f}s", said or "ok", flush=True)
