"""Audits: column profiles, expectations, coverage-based types, fingerprints, header repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import nulled, number


def audit(frame: DataFrame, key: str, group: str, columns: list[str]) -> DataFrame:
    """(group, variable, rows with key, keys, finite, empty, invalid, not positive), from text or number columns."""
    long = frame.select(F.col(key).alias("_k"), F.col(group).alias("group"), *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(["_k", "group"], columns, "variable", "value")
    v = number(F.col("value"))
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    empty = nulled(F.col("value")).isNull()
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return long.groupBy("group", "variable").agg(F.count("_k").alias("rows_with_key"), F.count_distinct("_k").alias("keys"), count(finite).alias("finite"), count(empty).alias("empty"), count(~empty & ~F.coalesce(finite, F.lit(False))).alias("invalid"), count(finite & (v <= 0)).alias("not_positive"))


def expect(frame: DataFrame, rules: dict[str, Column], stop: bool = False) -> DataFrame:
    """(rule, violations): rows that break each rule, all in one aggregate; with `stop`, any raises an error."""
    one = frame.agg(*[F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).alias(n) for n, c in rules.items()])
    out = one.unpivot([], list(rules), "rule", "violations")
    if stop and (bad := [f"{r[0]}: {r[1]}" for r in out.filter("violations > 0").collect()]):
        raise ValueError("; ".join(bad))
    return out


def duplicate_keys(frame: DataFrame, key: str) -> DataFrame:
    return frame.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("rows")).filter("rows > 1")


#: Parts of the names of columns of dates and of identifiers.
DATES, IDENTIFIERS = ("fecha", "date", "nacim", "birth", "dob"), ("id", "codigo", "código", "code", "patient")


def date_like(name: str) -> bool:
    return any(h in name.lower() for h in DATES)


def id_like(name: str) -> bool:
    return any(h in name.lower() for h in IDENTIFIERS)


#: How days and times of day are written, what is likelier first: the month leads only where the day can't.
DAYS = ("d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "yyyy-M-d", "yyyy/M/d", "d MMM yyyy", "d/M/yy", "M/d/yyyy", "M-d-yyyy")
TIMES = (" H:mm", " H:mm:ss", " H:mm:ss.SSS", "'T'H:mm:ss", "'T'H:mm:ss.SSS")


def day_first(c: Column) -> Column:
    """A time, from a day with or without a time of day: one try a notation of the day, by how many marks the text has."""
    text = F.trim(c)
    timed = F.contains(text, F.lit(":"))
    days = [F.try_to_timestamp(text, F.lit(p)) for p in DAYS]
    times = [F.try_to_timestamp(text, F.lit(p + t)) for p in DAYS for t in TIMES]
    return F.when(timed, F.coalesce(*times)).otherwise(F.coalesce(*days))


def promote(frame: DataFrame) -> DataFrame:
    """Text columns as times or numbers where enough of their values are: one aggregate, then one projection."""
    text = [f.name for f in frame.schema.fields if f.dataType.simpleString() == "string"]
    clean = frame.withColumns({c: nulled(F.col(c)) for c in text})
    if not text:
        return frame
    s = clean.agg(*[x for c in text for x in (F.count(c).alias(f"n_{c}"), F.count(day_first(F.col(c))).alias(f"d_{c}"), F.count(number(F.col(c))).alias(f"v_{c}"))]).first()
    new = {}
    for c in text:
        n, d, v = s[f"n_{c}"], s[f"d_{c}"], s[f"v_{c}"]
        if date_like(c) and d >= max(3, n // 2):
            new[c] = day_first(F.col(c))
        elif not id_like(c) and v >= max(3, int(0.8 * n)):
            new[c] = number(F.col(c))
    return clean.withColumns(new) if new else clean


def fingerprint(frame: DataFrame) -> DataFrame:
    """(rows, total, first, second): a fingerprint of the rows that doesn't depend on their order, of each row's SHA-256.

    Columns are joined as text, nulls left out; total and first are of a hash's first 60 bits, second of the next 60.
    """
    sha = F.sha2(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in frame.columns]), 256)
    bits = lambda at: F.conv(F.substring("s", at, 15), 16, 10).cast("bigint")
    rows = frame.select(sha.alias("s"))
    return rows.agg(F.count("*").alias("rows"), F.sum(bits(1).cast("decimal(38,0)")).cast("string").alias("total"), F.bit_xor(bits(1)).alias("first"), F.bit_xor(bits(16)).alias("second"))


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of each file below a path; a source file is read whole, by one task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def headers(grid: DataFrame, mark: str, within: int) -> DataFrame:
    """(sheet, header): of a grid (sheet, row_idx, col_idx, value), the first of `within` + 3 rows with the mark, else row `within`."""
    hit = grid.filter((F.col("row_idx") < within + 3) & (F.trim("value") == mark)).groupBy("sheet").agg(F.min("row_idx").alias("h"))
    return grid.select("sheet").distinct().join(hit, "sheet", "left").select("sheet", F.coalesce("h", F.lit(within)).alias("header"))


def bodies(grid: DataFrame, found: DataFrame, columns: list[str]) -> DataFrame:
    """(sheet, row_idx, one text column a name of `columns`) of the rows below each sheet's header, matched to names by header cell.

    grid is (sheet, row_idx, col_idx, value), found what headers() gives; a sheet's header row is small and joined by a broadcast.
    """
    marked = grid.join(F.broadcast(found), "sheet")  # a row a sheet
    names = marked.filter("row_idx = header").select("sheet", "col_idx", F.trim("value").alias("name"))
    cells = marked.filter("row_idx > header").join(F.broadcast(names), ["sheet", "col_idx"])  # a row a column of a sheet
    return cells.groupBy("sheet", "row_idx").agg(*[F.max(F.when(F.col("name") == c, F.col("value"))).alias(c) for c in columns])


def column_names(cells: DataFrame) -> DataFrame:
    """(sheet, col_idx, name) of header cells (sheet, col_idx, value): merged headers spread, names made unique.

    A named cell spans the unnamed ones after it; if its last words, one a column, are short, they become suffixes of
    the rest; else columns are numbered. A name's second occurrence gets `__2`.
    """
    unnamed = F.coalesce(F.trim("value") == "", F.lit(True)) | F.col("value").startswith("Unnamed:")
    run = Window.partitionBy("sheet").orderBy("col_idx")
    spread = cells.withColumn("base", F.last(F.when(~unnamed, F.trim("value")), True).over(run)).withColumn("part", F.sum(F.when(unnamed, 0).otherwise(1)).over(run))
    mine = Window.partitionBy("sheet", "part")
    spread = spread.withColumn("span", F.count("*").over(mine)).withColumn("at", F.row_number().over(mine.orderBy("col_idx")))
    tokens = F.split("base", r"\s+")
    tail = F.slice(tokens, -F.col("span"), F.col("span"))
    short = (F.size(tokens) > F.col("span")) & (F.col("span") > 1) & F.forall(tail, lambda t: F.length(t) <= 6)
    stem = F.regexp_replace(F.array_join(F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - F.col("span"), F.lit(0))), " "), r"[,;:/\-\s]+$", "")
    name = F.when(F.col("span") == 1, F.col("base")).when(short, F.concat_ws(" ", stem, F.get(tail, F.col("at") - 1))).when(F.col("at") == 1, F.col("base")).otherwise(F.concat(F.col("base"), F.lit(" ["), F.col("at").cast("string"), F.lit("]")))
    named = spread.withColumn("name", F.coalesce(name, F.concat(F.lit("column_"), F.col("col_idx").cast("string"))))
    nth = F.row_number().over(Window.partitionBy("sheet", "name").orderBy("col_idx"))
    return named.withColumn("_n", nth).select("sheet", "col_idx", F.when(F.col("_n") == 1, F.col("name")).otherwise(F.concat(F.col("name"), F.lit("__"), F.col("_n").cast("string"))).alias("name"))
