"""Importance resampling towards a target: documents are weighed by their n-grams' gains, disturbed by hash, and the highest are drawn."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import CHUNK_BYTES, LOWER, MARKS, arrow_map, chunks, fresh, keep, parts, ragged, table, utf8, words

#: xxhash64's primes, fixed values of the public algorithm.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
#: Bytes that the vectorised hash takes; longer n-grams are hashed one by one.
SHORT = 31


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def xxhash64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """xxhash64, seed 0, of many spans of bytes: those of up to SHORT bytes by 8-byte, 4-byte and single steps, all at once."""
    size = ends - starts
    held = np.concatenate([data, np.zeros(8, np.uint8)])
    raw = held.tobytes()
    eight, four = np.ndarray((len(held) - 7,), "<u8", raw, strides=(1,)), np.ndarray((len(held) - 3,), "<u4", raw, strides=(1,))
    h, at = P5 + size.astype(np.uint64), starts.copy()
    for k in range(SHORT // 8):
        rows = np.flatnonzero((size >= 8 * k + 8) & (size <= SHORT))
        if not len(rows):
            break
        h[rows] = _turned(h[rows] ^ (_turned(eight[at[rows]] * P2, 31) * P1), 27) * P1 + P4
        at[rows] += 8
    rows = np.flatnonzero((ends - at >= 4) & (size <= SHORT))
    h[rows] = _turned(h[rows] ^ (four[at[rows]].astype(np.uint64) * P1), 23) * P2 + P3
    at[rows] += 4
    for _ in range(3):
        rows = np.flatnonzero((ends > at) & (size <= SHORT))
        if not len(rows):
            break
        h[rows] = _turned(h[rows] ^ (held[at[rows]].astype(np.uint64) * P5), 11) * P1
        at[rows] += 1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(size > SHORT).tolist():
        h[i] = xxhash.xxh64_intdigest(raw[starts[i] : ends[i]])
    return h


class Interned:
    """An open-addressed table of the n-grams of a batch: keys by xxhash64, equal only if their bytes are; one slot a content.

    `slot` is each occurrence's slot; `bucket` and `count` belong to slots (of free ones the count is nought).
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, buckets: int):
        n = len(starts)
        cells = 1 << max(4, (2 * n).bit_length())
        mask = np.int64(cells - 1)
        keys = xxhash64(data, starts, ends)
        first = np.full(cells, -1, np.int64)  # the occurrence that took the slot
        self.slot = (keys & np.uint64(mask)).astype(np.int64)
        left = np.arange(n)
        while len(left):
            at = self.slot[left]
            free = first[at] < 0
            first[at[free]] = left[free]  # of rivals the last one takes it; the others compare themselves with it
            held = first[at]
            same = (held == left) | ((keys[held] == keys[left]) & self._equal(data, starts, ends, held, left))
            left = left[~same]
            self.slot[left] = (self.slot[left] + 1) & mask
        self.count = np.bincount(self.slot, minlength=cells)
        self.bucket = np.zeros(cells, np.int64)
        raw, taken = data.tobytes(), np.flatnonzero(first >= 0)
        own = first[taken]
        self.bucket[taken] = [zlib.crc32(raw[a:b]) % buckets for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True)]

    @staticmethod
    def _equal(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether spans a[i] and b[i] hold the same bytes."""
        size = ends[a] - starts[a]
        out = size == ends[b] - starts[b]
        rows = np.flatnonzero(out & (a != b))
        unlike = data[ragged(starts[a[rows]], size[rows])] != data[ragged(starts[b[rows]], size[rows])]
        out[rows[np.unique(np.repeat(np.arange(len(rows)), size[rows])[unlike])]] = False
        return out


def features(data: np.ndarray, offsets: np.ndarray, sizes: range) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, text) of all runs of n consecutive words joined by blanks, n of sizes, text by text, and words by text."""
    lower = LOWER[data]
    a, b, before = words(lower, offsets, MARKS)
    n = b - a
    stream = lower
    if max(sizes) > 1:  # words side by side, each with a blank behind it
        ends = np.cumsum(n + 1) - 1
        stream = np.full(int(n.sum() + len(n)), 32, np.uint8)
        stream[ragged(ends - n, n)] = lower[ragged(a, n)]
        a, b = ends - n, ends
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    runs = []
    for k in sizes:
        if 0 < k <= len(a):
            whole = owner[: len(owner) - k + 1] == owner[k - 1 :]
            runs.append((a[: len(a) - k + 1][whole], b[k - 1 :][whole], owner[: len(owner) - k + 1][whole]))
    if not runs:
        zero = np.zeros(0, np.int64)
        return stream, zero, zero, zero, np.diff(before)
    starts, ends, text = (np.concatenate([r[i] for r in runs]) for i in range(3))
    order = np.argsort(text, kind="stable") if len(runs) > 1 else slice(None)
    return stream, starts[order], ends[order], text[order], np.diff(before)


def bucket_counts(frame: DataFrame, text: str, sizes: range, buckets: int) -> DataFrame:
    """(bucket, n): occurrences of features of all texts by bucket; a task sends one row a bucket at most."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in parts(batch):
                data, offsets = utf8(part.column(0))
                for a, b in chunks(np.diff(offsets), CHUNK_BYTES // 2):
                    own, starts, ends, *_ = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], sizes)
                    seen = Interned(own, starts, ends, buckets)
                    used = np.flatnonzero(seen.count)
                    np.add.at(total, seen.bucket[used], seen.count[used])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    each = frame.select(text).mapInArrow(run, "bucket bigint, n bigint")
    return each.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each bucket, s of S features in it in raw, t of T in target, B buckets."""
    b, s_all, t_all = len(raw), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + b) / ((s + 1.0) * (t_all + b)))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def noise(key: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln(u))), u from the first 32 bits of sha256 of seed and key: a Gumbel variable, the same wherever it is computed."""
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def numbered(frame: DataFrame, *order: Column) -> DataFrame:
    """frame with `rank` from 1 in an order that tells all rows apart: sorted by ranges, numbered within, offset by the ranges' sizes.

    No task holds more than a range, and what is broadcast has a row a range. The sorted ranges are written before
    they are numbered for good, so that a lost executor can't deal them anew.
    """
    part, local, names = fresh(frame, "part"), fresh(frame, "local"), frame.columns
    own = frame.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(part, F.spark_partition_id()).withColumn(local, F.lit(0).cast("bigint"))

    def run(batches):
        n = 0
        for batch in batches:
            yield batch.set_column(batch.num_columns - 1, local, pa.array(np.arange(n + 1, n + 1 + batch.num_rows)))
            n += batch.num_rows

    held = keep(own.mapInArrow(run, own.schema))
    size = held.groupBy(part).agg(F.max(local).alias("_size"))
    offset = size.select(part, (F.sum("_size").over(Window.orderBy(part)) - F.col("_size")).alias("_offset"))  # a row a range
    return held.join(F.broadcast(offset), part).select(*names, (F.col(local) + F.col("_offset")).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int, sizes: range = range(1, 2), buckets: int = 10_000, least: int = 20, seed: int = 2024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_features, weight, score, rank) of every row of docs; the drawn ones, by score, have a rank from 1.

    A document's weight sums the gains of its features' buckets, its score adds the noise of its key. Of the N documents
    with at least `least` words, floor(percent * N / 100) are drawn, those of the highest scores, ties to smaller keys
    (null keys last; their noise is that of the seed alone). A null or empty text has no features and weight 0; an empty target or docs leaves gains that follow
    from the formula. Rows that repeat count as often as they stand and each has a row; other columns play no part.
    """
    docs = docs.select(key, text)
    kind = docs.schema[key].dataType.simpleString()
    counts = []
    for frame in (docs, target):
        out = np.zeros(buckets, np.int64)
        for r in bucket_counts(frame, text, sizes, buckets).collect():  # a row a bucket
            out[r[0]] = r[1]
        counts.append(out)
    sent = docs.sparkSession.sparkContext.broadcast(gains(*counts))

    def run(batch):
        data, offsets = utf8(batch.column(1))
        out = []
        for a, b in chunks(np.diff(offsets), CHUNK_BYTES // 2):
            own, starts, ends, owner, n_words = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], sizes)
            seen = Interned(own, starts, ends, buckets)
            gain = np.append(0, np.cumsum(sent.value[seen.bucket][seen.slot]))
            at = np.searchsorted(owner, np.arange(b - a + 1))
            out.append((np.diff(at), np.diff(gain[at]), n_words))
        n, weight, n_words = (np.concatenate([x[i] for x in out]) for i in range(3))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x.astype(np.int64)) for x in (n, weight, n_words))], names=[key, "n_features", "weight", "_words"])

    weighed = keep(arrow_map(docs, run, f"`{key}` {kind}, n_features long, weight long, _words long").withColumn("score", F.col("weight") + noise(F.col(key), seed)))
    fit = weighed.filter(F.col("_words") >= least)
    many = percent * fit.count() // 100
    ranked = numbered(fit.select(key, "n_features", "weight", "score"), F.desc("score"), F.asc_nulls_last(key))
    rest = weighed.filter(F.col("_words") < least).select(key, "n_features", "weight", "score", F.lit(None).cast("bigint").alias("rank"))
    return ranked.withColumn("rank", F.when(F.col("rank") <= many, F.col("rank"))).unionByName(rest)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents weighed towards the benchmark by single words in 10,000 buckets; of those with 20 words or more, 10 % drawn."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


_BUCKETS = """
SELECT w, xor(list_reduce(list_prepend(4294967295, [CAST(('0x' || substr(hex(encode(w)), 2 * i + 1, 2)) AS BIGINT) for i in range(octet_length(encode(w)))]),
 lambda c, x: xor(c >> 8, steps[xor(c & 255, x) + 1])), 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT w FROM words), (SELECT list(v ORDER BY b) AS steps FROM crc)"""
ORACLE = f"""
WITH RECURSIVE steps AS (SELECT b, 0 AS k, b AS v FROM range(256) AS t(b) UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END FROM steps WHERE k < 8),
crc AS (SELECT b, v FROM steps WHERE k = 8),
texts AS (SELECT 0 AS side, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
own AS (SELECT side, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM texts),
words AS (SELECT side, r, unnest(ws) AS w FROM own),
bucket AS ({_BUCKETS}),
each AS (SELECT side, r, bucket, count(*) AS n FROM words JOIN bucket USING (w) GROUP BY ALL),
sums AS (SELECT bucket, sum(CASE side WHEN 0 THEN n ELSE 0 END) AS s, sum(CASE side WHEN 1 THEN n ELSE 0 END) AS t FROM each GROUP BY 1),
gain AS (SELECT bucket, floor(1000 * ln((t::DOUBLE + 1) * (sum(s) OVER () + 10000)::DOUBLE / ((s::DOUBLE + 1) * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS g FROM sums),
weight AS (SELECT r, sum(n * g)::BIGINT AS weight FROM each JOIN gain USING (bucket) WHERE side = 0 GROUP BY 1),
scored AS (SELECT r, doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM own LEFT JOIN weight USING (r) WHERE side = 0),
fit AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN fit USING (r)
"""
