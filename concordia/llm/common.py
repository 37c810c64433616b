"""Helpers the text operators share: Arrow batches of bounded size, hashing of ragged arrays, shared folders."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of a part of an Arrow batch, and characters of text that numpy works on at once (a longer text goes alone).
BATCH_ROWS, PART_BYTES, CHUNK_BYTES = 400, 8_000_000, 1_000_000
#: The modulus of span_hashes(), a prime, and two bases for it; quick_hashes() calculates modulo 2**64.
PRIME, BASES = np.uint64((1 << 61) - 1), (0x1A2B5C9E3779B97F, 0x0D1342543DE82EF9)
QUICK = 0x9E3779B97F4A7C15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(frame: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator], schema: str) -> DataFrame:
    """frame through function, part by part of its Arrow batches; parts hold few rows and bytes, so that long texts fit in a worker."""

    def run(batches):
        for batch in batches:
            for part in parts(batch):
                out = function(part)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return frame.mapInArrow(run, schema)


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch, which Spark bounds by bytes, in parts of BATCH_ROWS rows and about PART_BYTES bytes at most, or of one row."""
    if batch.num_rows:
        rows = max(1, min(BATCH_ROWS, PART_BYTES * batch.num_rows // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def chunks(lengths: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose lengths sum up to limit at most, or single rows."""
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(lengths):
        yield start, len(lengths)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_M30, _M31 = np.uint64((1 << 30) - 1), np.uint64((1 << 31) - 1)
_30, _31, _61, _ONE = np.uint64(30), np.uint64(31), np.uint64(61), np.uint64(1)


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME."""
    x = (x & PRIME) + (x >> _61)
    return x - PRIME * (x >= PRIME)


def multiplied(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, by halves of 31 bits; both are below it."""
    bh, bl = b >> _31, b & _M31
    if a.dtype.itemsize < 8:  # a is below 2**31
        a = a.astype(np.uint64)
        mid = a * bh
        return reduced((mid >> _30) + ((mid & _M30) << _31) + a * bl)
    ah, al = a >> _31, a & _M31
    mid = ah * bl + al * bh
    return reduced(((ah * bh) << _ONE) + (mid >> _30) + ((mid & _M30) << _31) + al * bl)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_QUICK_POWERS: list[np.ndarray] = []


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo PRIME."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        pair = []
        for b in (base, pow(base, -1, int(PRIME))):
            p = np.ones(1, np.uint64)
            while len(p) < max(n, 1 << 16):
                p = np.concatenate([p, multiplied(p, np.uint64(pow(b, len(p), int(PRIME))))])
            pair.append(p)
        have = _POWERS[base] = tuple(pair)
    return have[0][:n], have[1][:n]


class Spans:
    """Hashes of spans of values by sums of values times powers of a base, modulo a prime: equal content, equal hash.

    Different contents of up to n values meet with a chance of n / 2**61. Values are taken modulo the prime.
    """

    def __init__(self, values: np.ndarray, base: int = BASES[0]):
        up, self.down = powers(len(values) + 1, base)
        if values.dtype.itemsize < 8:
            term = multiplied(values.astype(np.uint32) + np.uint32(1), up[:-1])
        else:
            term = multiplied(reduced(reduced(values) + _ONE), up[:-1])
        self.high, self.low = np.zeros(len(values) + 1, np.uint64), np.zeros(len(values) + 1, np.uint64)
        np.cumsum(term >> _31, out=self.high[1:])
        np.cumsum(term & _M31, out=self.low[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        high, low = self.high[ends] - self.high[starts], self.low[ends] - self.low[starts]
        total = reduced((high >> _30) + ((high & _M30) << _31) + low)
        return mix(multiplied(total, self.down[starts]))

    def windows(self, size: int) -> np.ndarray:
        """Hashes of all windows of a size."""
        n = len(self.high) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        high, low = self.high[size:] - self.high[:n], self.low[size:] - self.low[:n]
        return mix(multiplied(reduced((high >> _30) + ((high & _M30) << _31) + low), self.down[:n]))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """Hashes of values[start:end] for many spans."""
    return Spans(values, base).of(starts, ends)


def window_hashes(values: np.ndarray, size: int, base: int = BASES[0]) -> np.ndarray:
    """Hashes of all windows of a size over values."""
    return Spans(values, base).windows(size)


def quick_windows(values: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of a size modulo 2**64, where meeting by chance costs time only: contents can be made to meet."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if not _QUICK_POWERS or len(_QUICK_POWERS[0]) <= len(values):
        pair = []
        for b in (QUICK, pow(QUICK, -1, 1 << 64)):
            p = np.full(max(len(values) + 1, 1 << 16), np.uint64(b))
            p[0] = 1
            pair.append(np.multiply.accumulate(p))
        _QUICK_POWERS[:] = pair
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + _ONE) * _QUICK_POWERS[0][: len(values)], out=total[1:])
    return mix((total[size:] - total[:n]) * _QUICK_POWERS[1][:n])


SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


#: Bytes that plain word tokens leave out: ASCII other than letters and digits.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, runs without bytes of between (ASCII white space), of concatenated texts: starts, ends, and the words before each text."""
    if not len(data):
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(offsets), np.int64)
    solid = ~between[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def anchors(hashes: np.ndarray, window: int) -> np.ndarray:
    """For each run of window hashes, the position of its smallest (the first of equals), by doubling.

    It depends on the run's content alone: content repeated anywhere meets itself at an anchor.
    """
    if len(hashes) < window:
        return np.zeros(0, np.int32)
    low, at, have = hashes, np.arange(len(hashes), dtype=np.int32), 1
    while have < window:
        step = min(have, window - have)
        later = low[step:] < low[:-step]
        at = np.where(later, at[step:], at[:-step])
        low = np.minimum(low[:-step], low[step:])
        have += step
    return at


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... for each pair, concatenated."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def shared_dir(spark: SparkSession) -> str:
    """A fresh path in the folder that the cluster shares; a temporary folder only on one machine, where none is set, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/concordia-{os.getpid()}"
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def keep(frame: DataFrame) -> DataFrame:
    """frame, written to the shared folder and read again: cuts lineage, and outlives lost executors."""
    spark, path = frame.sparkSession, shared_dir(frame.sparkSession)
    frame.write.parquet(path)
    out = spark.read.schema(frame.schema).parquet(path)
    out.__dict__["_kept_at"] = path
    return out


def drop(*frames: DataFrame | None) -> None:
    """Deletes what keep() wrote for frames; nothing that is still to run may read it."""
    for frame in frames:
        if frame is not None and (path := frame.__dict__.pop("_kept_at", None)):
            where = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(frame.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stored_bytes(frame: DataFrame) -> int:
    """Bytes of the files that keep() wrote for frame."""
    where = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(frame.__dict__["_kept_at"])
    return where.getFileSystem(frame.sparkSession.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def fresh(frame: DataFrame, name: str) -> str:
    """name, with underscores before it until frame has no such column (columns differ by more than case)."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def crc32_mod(column: str, n: int):
    return F.crc32(F.col(column).cast("string").cast("binary")) % n
