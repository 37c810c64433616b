"""Vector codes: each part of a vector is written as the number of its nearest codebook entry; pivots prune the comparisons."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, keep, stored_bytes, table
from .topk import matrix

#: Pivots of each part position, and bytes of error sums by label up to which they are broadcast.
PIVOTS, SMALL = 4, 8_000_000
#: Rows that are compared at once.
ROWS = 4096
#: Integers beyond this size could overflow their squares' sums.
LARGEST = 1 << 27


def pivot_rows(book: np.ndarray, many: int) -> np.ndarray:
    """Entries of a codebook far from each other: the first, then each time the one farthest from those chosen, the first of equals."""
    out = [0] if len(book) else []
    while len(out) < min(many, len(book)):
        gap = ((book[:, None] - book[out][None]) ** 2).sum(2).min(1)
        if not gap.max():
            break
        out.append(int(gap.argmax()))
    return book[out]


def roots(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of all points from all pivots."""
    return np.sqrt(((points[:, None] - pivots[None]) ** 2).sum(2).astype(np.float64))


def nearest(points: np.ndarray, reach: np.ndarray, book: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(entry, squared distance) of each point's nearest entry, ties to the lower index, and how many pairs were evaluated.

    reach holds the points' distances from the pivots. No entry is nearer than the largest difference between its and the
    point's distance from a pivot; entries are tried in the order of that bound, in integers, until it passes the best.
    """
    n = len(points)
    low = np.zeros((n, len(book)))
    for own, other in zip(reach.T, roots(book, pivots).T, strict=True):
        np.maximum(low, np.abs(own[:, None] - other[None]), out=low)
    low *= 1 - 1e-9  # below the true bound, whatever was rounded
    order = np.argsort(low, axis=1, kind="stable")
    best, entry, evaluated = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64), 0
    left = np.arange(n)
    for k in range(len(book)):
        e = order[left, k]
        bound = low[left, e] - 1e-6
        left = left[~((bound > 0) & (bound * bound > best[left]))]
        if not len(left):
            break
        e = order[left, k]
        evaluated += len(left)
        d = ((points[left] - book[e]) ** 2).sum(1)
        better = (d < best[left]) | ((d == best[left]) & (e < entry[left]))
        best[left[better]], entry[left[better]] = d[better], e[better]
    return entry, best, evaluated


def integers(frame: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, v, label): floor(256 * x) of each component; rows with a null vector or one with null or non-finite components go."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = frame.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).alias("label")).filter(F.col("v").isNotNull() & finite)
    return rows.withColumn("v", F.transform("v", lambda x: F.floor(x * 256)))


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of every vector that is kept.

    Vectors are floored to integers and cut into equal parts; each part position has a codebook of up to 256 entries, the
    vectors of the smallest keys at first, which a round replaces by the floored means of the parts nearest to them.
    Vectors that are null or hold null or non-finite components go. Vectors whose length isn't a multiple of `parts`, or
    less than the longest, count as filled up with noughts; an empty vector is all noughts. Rows that repeat count as often
    as they stand; a null key comes last when codebooks begin and stays null in the result; fewer vectors than entries
    make fewer entries, no vectors an empty result. Components beyond 2**27 after flooring are an error. Other columns
    play no part.

    Each vector's distances from the pivots, entries of the first codebooks, are computed once and stored with it; what
    reaches the driver each round has a row a part and entry.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries are written with two hex digits")
    spark = vectors.sparkSession
    kinds = vectors.schema[key].dataType.simpleString(), vectors.schema[label].dataType.simpleString()
    rows = keep(integers(vectors, key, vector, label))
    most, longest = rows.agg(F.max(F.array_max(F.transform("v", F.abs))), F.max(F.size("v"))).first()
    if longest is None:
        drop(rows)
        return spark.createDataFrame([], f"`{key}` {kinds[0]}, code string, error long, label_error long, codebooks_sha256 string")
    if (most or 0) > LARGEST:
        raise ValueError(f"components must not exceed {LARGEST} after flooring")
    width = -(-max(longest, 1) // parts)  # of a part
    first = [r[0] for r in rows.orderBy(F.asc_nulls_last("id"), "v").select("v").limit(entries).collect()]
    books = matrix(pa.array(first, pa.list_(pa.int64())), parts * width).reshape(len(first), parts, width).transpose(1, 0, 2)
    pivots = [pivot_rows(book, PIVOTS) for book in books]
    cuts = np.append(0, np.cumsum([len(p) for p in pivots]))

    def placed(batch: pa.RecordBatch):
        for a in range(0, batch.num_rows, ROWS):
            some = batch.slice(a, ROWS)
            points = matrix(some.column("v"), parts * width).reshape(some.num_rows, parts, width)
            yield some, points

    def measure(batches):
        for batch in batches:
            for some, points in placed(batch):
                reach = np.hstack([roots(points[:, j], pivots[j]) for j in range(parts)])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(some.num_rows + 1) * reach.shape[1], pa.int32()), pa.array(reach.ravel()))
                yield pa.RecordBatch.from_arrays([*some.columns, lists], names=["id", "v", "label", "reach"])

    measured = keep(rows.mapInArrow(measure, f"id {kinds[0]}, v array<bigint>, label {kinds[1]}, reach array<double>"))
    drop(rows)

    def assigned(batch: pa.RecordBatch, books: np.ndarray):
        for some, points in placed(batch):
            reach = np.asarray(some.column("reach").flatten()).reshape(some.num_rows, -1)
            found = [nearest(points[:, j], reach[:, cuts[j] : cuts[j + 1]], books[j], pivots[j]) for j in range(parts)]
            yield some, points, np.stack([f[0] for f in found], 1), sum(f[1] for f in found)

    for _ in range(rounds):

        def sums(batches, books=books):
            many, total = np.zeros((parts, len(first)), np.int64), np.zeros((parts, len(first), width), np.int64)
            for batch in batches:
                for _, points, entry, _ in assigned(batch, books):
                    at = np.arange(parts)[None].repeat(len(points), 0)
                    np.add.at(many, (at, entry), 1)
                    np.add.at(total, (at, entry), points)
            j, e = np.nonzero(many)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(j) + 1) * width, pa.int32()), pa.array(total[j, e].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(j), pa.array(e), pa.array(many[j, e]), flat], names=["part", "entry", "n", "total"])

        each = measured.mapInArrow(sums, "part bigint, entry bigint, n bigint, total array<bigint>").groupBy("part", "entry")
        new = each.agg(F.sum("n"), *[F.sum(F.col("total")[i]) for i in range(width)]).collect()
        books = books.copy()
        for j, e, n, *total in new:
            books[j, e] = [x // n for x in total]

    def encode(batches, books=books):
        for batch in batches:
            for some, _, entry, error in assigned(batch, books):
                code = [x.tobytes().hex() for x in entry.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([some.column("id"), pa.array(code, pa.string()), pa.array(error), some.column("label")], names=["id", "code", "error", "label"])

    coded = keep(measured.mapInArrow(encode, f"id {kinds[0]}, code string, error bigint, label {kinds[1]}"))
    drop(measured)
    by_label = keep(coded.groupBy(F.col("label").alias("_of")).agg(F.sum("error").alias("label_error")))
    sizes = F.broadcast(by_label) if stored_bytes(by_label) <= SMALL else by_label
    digest = hashlib.sha256(",".join(str(x) for x in books.ravel().tolist()).encode()).hexdigest()
    out = coded.join(sizes, F.col("label").eqNullSafe(F.col("_of")))
    return out.select(F.col("id").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings: 16 parts, 64 entries each, two rounds."""
    return compress(table(spark, sf_dir, "embeddings"))


def _round(k: int) -> str:
    """Assignment to the codebooks of round k, and the codebooks after it."""
    return f"""
a{k} AS (SELECT id, p.part, min(list_sum([(x[1] - x[2]) * (x[1] - x[2]) for x in list_zip(p.v, b.v)]) * 64 + b.entry)::BIGINT AS m FROM parts p JOIN b{k} b ON p.part = b.part GROUP BY id, p.part),
u{k} AS (SELECT part, entry, list(m ORDER BY i) AS v FROM (SELECT part, entry, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS m FROM (SELECT p.part, m % 64 AS entry, i, sum(p.v[i])::BIGINT AS s, count(*) AS n FROM a{k} JOIN parts p USING (id, part), range(1, 1 + (SELECT max(len(v)) FROM parts)) AS t(i) GROUP BY 1, 2, 3)) GROUP BY 1, 2),
b{k + 1} AS (SELECT b.part, b.entry, coalesce(u.v, b.v) AS v FROM b{k} b LEFT JOIN u{k} u USING (part, entry))"""


ORACLE = f"""
WITH kept AS (SELECT vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v, row_number() OVER (ORDER BY vec_id) - 1 AS id FROM embeddings WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
parts AS (SELECT id, part, v[part * (len(v) // 16) + 1 : (part + 1) * (len(v) // 16)] AS v FROM kept, range(16) AS t(part)),
b0 AS (SELECT part, id AS entry, v FROM parts WHERE id < 64), {_round(0)}, {_round(1)},
last AS (SELECT id, p.part, min(list_sum([(x[1] - x[2]) * (x[1] - x[2]) for x in list_zip(p.v, b.v)]) * 64 + b.entry)::BIGINT AS m FROM parts p JOIN b2 b ON p.part = b.part GROUP BY id, p.part),
coded AS (SELECT id, string_agg(printf('%02x', m % 64), '' ORDER BY part) AS code, sum(m // 64)::BIGINT AS error FROM last GROUP BY id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM b2) AS codebooks_sha256 FROM kept JOIN coded USING (id)
"""
