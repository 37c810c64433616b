"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, MARKS, arrow_map, chunks, crc32_mod, table, utf8

#: Byte lengths of the n-grams, their hash buckets, and the share of rows that a score must reach to be called toxic.
SIZES, BUCKETS, THRESHOLD = (4, 5, 6), 1 << 18, 0.7
#: Log-count ratios nearer to nought count as nought.
CUT = 2.0
#: The classifier is fitted on so many labelled rows of each class at most, chosen by hash, of so many bytes each and in all.
ROWS, LONGEST, TOTAL = 1000, 20_000, 8_000_000


def grams(data: np.ndarray, offsets: np.ndarray):
    """(text, bucket) of every n-gram of lower-cased bytes, length by length.

    ASCII marks and white space count as blanks, runs of them as one, and each text has a blank on either side.
    """
    n = len(offsets) - 1
    sizes = np.diff(offsets) + 2
    at = np.append(0, np.cumsum(sizes))
    padded = np.full(int(at[-1]), 32, np.uint8)
    owner = np.repeat(np.arange(n), sizes)
    inner = np.ones(len(padded), bool)
    inner[at[:-1]] = inner[at[1:] - 1] = False
    padded[inner] = np.where(MARKS, 32, LOWER)[data]
    once = np.ones(len(padded), bool)
    once[1:] = (padded[1:] != 32) | (padded[:-1] != 32) | (owner[1:] != owner[:-1])
    padded, owner = padded[once], owner[once]
    wide = padded.astype(np.uint64)
    code = np.zeros(len(padded), np.uint64)
    for size in range(1, max(SIZES) + 1):
        code = (code[: len(code) - (size > 1)] << np.uint64(8)) | wide[size - 1 :] if size > 1 else wide
        if size in SIZES and len(code):
            good = owner[: len(code)] == owner[size - 1 :]
            h = ((code * np.uint64(0x9E3779B97F4A7C15) + np.uint64(size)) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BUCKETS.bit_length() + 1)
            yield owner[: len(code)][good], h[good].astype(np.int64)


class Model:
    """Weights by bucket and a bias, for features that are n-gram frequencies, scaled by root of length."""

    def __init__(self, texts: list[str], labels: list[int], rounds: int = 120, decay: float = 1e-4):
        y = np.array(labels, np.float64)
        self.weights, self.bias = np.zeros(BUCKETS, np.float32), 0.0
        self.tells = bool(len(y)) and y.min() != y.max()
        if not self.tells:
            self.bias = float(y.mean() * 20 - 10) if len(y) else -10.0
            return
        data, offsets = utf8(pa.array(texts, pa.string()))
        parts, p, q, total = [], np.ones(BUCKETS), np.ones(BUCKETS), np.zeros(len(y))
        for a, b in chunks(np.diff(offsets)):
            pairs = [(a + t) * BUCKETS + h for t, h in grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])]
            key, count = np.unique(np.concatenate(pairs), return_counts=True)
            row, col = key // BUCKETS, key % BUCKETS
            p += np.bincount(col, y[row], BUCKETS)
            q += np.bincount(col, 1 - y[row], BUCKETS)
            total += np.bincount(row, count, len(y))
            parts.append((key, count.astype(np.float32)))
        ratio = np.log((p / (y.sum() + 2)) / (q / ((1 - y).sum() + 2)))
        ratio[np.abs(ratio) < CUT] = 0
        parts = [(key[use], count[use]) for key, count in parts for use in [ratio[key % BUCKETS] != 0]]
        key, count = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
        row, col = key // BUCKETS, key % BUCKETS
        x = count * ratio[col] / np.sqrt(total)[row]
        w, b = np.ones(BUCKETS), 0.0
        gw2, gb2 = np.full(BUCKETS, 1e-6), 1e-6
        cost = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
        for _ in range(rounds):
            z = np.bincount(row, x * w[col], len(y)) + b
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * cost
            gw = np.bincount(col, x * g[row], BUCKETS) + decay * (w - 1) / BUCKETS
            gw2 += gw * gw
            gb2 += g.sum() ** 2
            w -= 0.1 * gw / np.sqrt(gw2)
            b -= 0.3 * g.sum() / np.sqrt(gb2)
        self.weights, self.bias = (w * ratio).astype(np.float32), float(b)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        total, z = np.zeros(n), np.zeros(n)
        for text, bucket in grams(data, offsets):
            total += np.bincount(text, minlength=n)
            z += np.bincount(text, self.weights[bucket], n)
        z = z / np.sqrt(np.maximum(total, 1)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from a bounded sample of the labelled rows; a key labelled twice counts with its larger label.

    Null labels, keys and texts teach nothing. Without rows of both labels, all texts get one and the same score.
    """
    order = F.xxhash64(F.lit("toxicity"), "_key")
    known = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label")).dropna().groupBy("_key").agg(F.max("_label").alias("_label"))
    counts = {r[0]: r[1] for r in known.groupBy("_label").count().collect()}
    share = F.coalesce(*[F.when(F.col("_label") == k, F.lit(4.0 * ROWS / n)) for k, n in counts.items()], F.lit(0.0))
    few = known.filter(F.pmod(order, F.lit(1 << 30)) < share * (1 << 30))
    texts = docs.select(F.col(key).alias("_doc"), F.col(text).alias("_text")).filter(F.octet_length("_text") <= LONGEST)
    some = F.broadcast(few).join(texts, F.col("_key") == F.col("_doc")) if counts else few.withColumn("_text", F.lit(""))  # few: about 8 * ROWS rows
    rank = F.row_number().over(Window.partitionBy("_label").orderBy(order, F.xxhash64("_text")))
    rows = some.select("_label", "_text", rank.alias("_rank")).filter(F.col("_rank") <= ROWS).orderBy("_rank").collect()
    texts, marks, size = [], [], 0
    for r in rows:
        size += len(r[1])
        if size <= TOTAL:
            texts.append(r[1])
            marks.append(int(r[0] > 0))
    return Model(texts, marks)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row, from its whole text; null counts as empty, which gets the model's bias for no evidence."""
    docs = docs.select(key, text)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        data, offsets = utf8(batch.column(1))
        out = [sent.value.score(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in chunks(np.diff(offsets))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out))], names=[key, "score"])

    return arrow_map(docs, run, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double")


def remove_toxic(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """docs without the rows whose score reaches the threshold; one pass, no join: the texts are scored where they are.

    Where labelled rows are of one kind only, or there are none, nothing tells what to remove, and nothing is.
    """
    model = fit(docs, labels, text=text)
    if not model.tells:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batch):
        data, offsets = utf8(batch.column(at))
        out = [sent.value.score(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in chunks(np.diff(offsets))]
        return batch.filter(pa.array(np.concatenate(out) < THRESHOLD))

    return arrow_map(docs, run, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.filter(crc32_mod("doc_id", 3) != 1))
    out = score(docs, model).withColumn("held_out", F.coalesce(crc32_mod("doc_id", 3) == 1, F.lit(False)))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
