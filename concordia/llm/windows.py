"""Substring dedup by words: windows repeated at one length alone are taken to twice that length, until the length is reached."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Spans, arrow_map, chunks, keep, parts, span_hashes, table, utf8, words

#: Words of a window whose repeats go, and of the windows counted first; each level is twice the one before, the last WIDTH.
WIDTH, FIRST = 35, 9
#: Bytes of text that are hashed together (a longer text goes alone), and hashes that are counted together, about.
BLOCK_BYTES, BUCKET = 4_000_000, 4_000_000
#: Bits that hashes of each level but the last have more than the number of windows needs: some windows meet by chance, which the
#: next level, where both halves must, tells apart. The last level's hashes are sent whole.
SPARE = 6


def levels(first: int, width: int) -> list[int]:
    """first, twice that, and so on, and width."""
    out = [min(first, width)]
    while out[-1] < width:
        out.append(min(2 * out[-1], width))
    return out


def blocks(frame: DataFrame, key: str, text: str) -> DataFrame:
    """(blk, ids, sizes, bytes, data): the rows of frame, put together up to BLOCK_BYTES, their texts compressed, written to the shared folder."""
    rows = frame.select(F.col(key).alias("_id"), F.col(text).alias("_text"))

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        data, offsets = utf8(whole.column(1).combine_chunks())
        ids = pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole.column(0).combine_chunks())
        small = pa.compress(data.tobytes(), codec="zstd", asbytes=True)
        return pa.RecordBatch.from_arrays([ids, pa.array([np.diff(offsets).tobytes()]), pa.array([len(data)]), pa.array([small])], names=["ids", "sizes", "bytes", "data"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in parts(batch):
                held.append(part)
                size += part.nbytes
                if size >= BLOCK_BYTES:
                    yield pack(held)
                    held, size = [], 0
        if held:
            yield pack(held)

    packed = rows.mapInArrow(run, f"ids array<{rows.schema['_id'].dataType.simpleString()}>, sizes binary, bytes bigint, data binary")
    return keep(packed.withColumn("blk", F.monotonically_increasing_id()))


class Plan:
    """The levels, the bits of each level's keys, and the buckets, a power of two, that keys are dealt to by their leading bits."""

    def __init__(self, width: int, total: int):
        self.levels = levels(FIRST, width)
        need = max(1, total // 6).bit_length()
        self.bits = [64 if k == len(self.levels) - 1 else min(64, need + SPARE * (k + 1)) for k in range(len(self.levels))]
        self.buckets = 1 << max(4, (total // 6 // BUCKET).bit_length())

    def starts(self, k: int) -> np.ndarray:
        """The least key of each bucket."""
        return np.arange(self.buckets, dtype=np.uint64) << np.uint64(self.bits[k] - self.buckets.bit_length() + 1)


class Block:
    """The words of a block's texts, as hashes; texts without a key have windows that meet nobody."""

    def __init__(self, plan: Plan, batch: pa.RecordBatch, row: int):
        get = lambda name: batch.column(name)[row]
        total = get("bytes").as_py()
        data = np.frombuffer(pa.decompress(get("data").as_buffer(), decompressed_size=total, codec="zstd"), np.uint8) if total else np.zeros(0, np.uint8)
        self.ids, offsets = get("ids").values, np.append(0, np.cumsum(np.frombuffer(get("sizes").as_buffer(), np.int64)))
        self.data, self.offsets = data, offsets
        found, at = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
        for a, b in chunks(np.diff(offsets)):
            own = data[offsets[a] : offsets[b]]
            starts, ends, cuts = words(own, offsets[a : b + 1] - offsets[a])
            found.append(span_hashes(own, starts, ends))
            at.append(cuts[1:] + at[-1][-1])
        self.plan, self.at = plan, np.concatenate(at)
        units = np.concatenate(found)
        self.spans, self.size = Spans(units), len(units)
        keyed = ~np.asarray(self.ids.is_null())
        self.end = np.repeat(np.where(keyed, self.at[1:], -1), np.diff(self.at))  # of each word's text

    def keys(self, k: int, again: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(start, key) of the windows of level k in one text whose two halves, of the level before, are marked in `again`."""
        level = self.plan.levels[k]
        n = self.size - level + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        good = np.arange(level, level + n) <= self.end[:n]
        if again is not None:
            step = level - self.plan.levels[k - 1]
            good &= again[:n] & again[step : step + n]
        start = np.flatnonzero(good)
        return start, self.spans.of(start, start + level) >> np.uint64(64 - self.plan.bits[k])

    def repeated(self, replies: list[list[dict]]) -> np.ndarray | None:
        """Which windows of the last level answered repeat; None before the first."""
        again = None
        for k, reply in enumerate(replies):
            start, key = self.keys(k, again)
            each, back = np.unique(key, return_inverse=True)
            cuts = np.append(np.searchsorted(each, self.plan.starts(k)), len(each))
            marks = np.zeros(len(each), bool)
            for r in reply or []:
                a, b = cuts[r["bucket"]], cuts[r["bucket"] + 1]
                marks[a:b] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=b - a)
            again = np.zeros(max(0, self.size - self.plan.levels[k] + 1), bool)
            again[start[marks[back]]] = True
        return again


def held(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Whether each wanted value is among the known, which are sorted."""
    if not len(known):
        return np.zeros(len(wanted), bool)
    return known[np.minimum(np.searchsorted(known, wanted), len(known) - 1)] == wanted


def packed(keys: np.ndarray, base: int) -> bytes:
    """Sorted keys as steps of so many bytes as most need; a step of all ones only moves on."""
    gap = np.diff(keys, prepend=np.uint64(base))
    mean = (int(keys[-1]) - base) // len(keys) + 1
    size = next(w for w in range(1, 9) if w == 8 or 4 * mean < 256**w)
    most = np.uint64(256**size - 1)
    ends = np.cumsum(gap // most + np.uint64(1)).astype(np.int64)
    steps = np.full(ends[-1], most)
    steps[ends - 1] = gap % most
    return bytes([size]) + steps.view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def unpacked(data: bytes, base: int) -> np.ndarray:
    size = data[0]
    steps = np.zeros(((len(data) - 1) // size, 8), np.uint8)
    steps[:, :size] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, size)
    steps = steps.view(np.uint64).ravel()
    return (np.cumsum(steps) + np.uint64(base))[steps != np.uint64(256**size - 1)]


def repeated(texts: DataFrame, replies: list[DataFrame], plan: Plan) -> DataFrame:
    """(blk, bucket, bits): of each key of the next level that a block sent to a bucket, in order, whether it occurs anywhere else.

    A block sends each of its keys once, with whether it has it twice, so a window that a third of all texts hold weighs
    as much in its bucket as one of each block.
    """
    k = len(replies)

    def send(batch):
        for row in range(batch.num_rows):
            block = Block(plan, batch, row)
            _, key = block.keys(k, block.repeated([batch.column(f"r{j}")[row].as_py() for j in range(k)]))
            own, count = np.unique(key, return_counts=True)
            starts = plan.starts(k)
            cuts = np.append(np.searchsorted(own, starts), len(own))
            use = np.flatnonzero(np.diff(cuts))
            keys = [packed(own[cuts[b] : cuts[b + 1]], int(starts[b])) for b in use]
            twice = [np.packbits(count[cuts[b] : cuts[b + 1]] > 1).tobytes() for b in use]
            blk = pa.array([batch.column("blk")[row].as_py()] * len(use), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(use.astype(np.int32)), blk, pa.array(keys, pa.binary()), pa.array(twice, pa.binary())], names=["bucket", "blk", "keys", "twice"])

    def answer(bucket: int, rows: list[tuple]) -> pa.RecordBatch:
        base = int(plan.starts(k)[bucket])
        each = [unpacked(keys, base) for _, keys, _ in rows]
        marked = [own[np.unpackbits(np.frombuffer(t, np.uint8), count=len(own)).astype(bool)] for own, (_, _, t) in zip(each, rows, strict=True)]
        every = np.sort(np.concatenate(each + marked))  # a key that a block has twice stands in it twice
        twice = every[1:][every[1:] == every[:-1]]
        bits = [held(twice, own) for own in each]
        use = [i for i, some in enumerate(bits) if some.any()]
        return pa.RecordBatch.from_arrays([pa.array([rows[i][0] for i in use], pa.int64()), pa.array([bucket] * len(use), pa.int32()), pa.array([np.packbits(bits[i]).tobytes() for i in use], pa.binary())], names=["blk", "bucket", "bits"])

    def count(batches) -> Iterator[pa.RecordBatch]:
        rows, bucket = [], None
        for batch in batches:
            for b, blk, keys, twice in zip(*(batch.column(c).to_pylist() for c in ("bucket", "blk", "keys", "twice")), strict=True):
                if b != bucket and rows:
                    yield answer(bucket, rows)
                    rows = []
                bucket = b
                rows.append((blk, keys, twice))
        if rows:
            yield answer(bucket, rows)

    sent = arrow_map(_with(texts, replies), send, "bucket int, blk bigint, keys binary, twice binary")
    return sent.repartition(plan.buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(count, "blk bigint, bucket int, bits binary")


def _with(texts: DataFrame, replies: list[DataFrame]) -> DataFrame:
    """Each block with what came back for it, level by level; one exchange of the blocks serves all levels."""
    for j, reply in enumerate(replies):
        texts = texts.join(reply.groupBy("blk").agg(F.collect_list(F.struct("bucket", "bits")).alias(f"r{j}")), "blk", "left")
    return texts


def dedup(frame: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(key, n_words, kept, starts, ends) of every row, without words covered by a `width`-word window that also starts elsewhere.

    Words are runs without ASCII white space, unchanged; kept words are joined by one blank. Windows are judged on the
    input. Null texts have no words; equal rows of one key are repeats of each other; rows with a null key are kept
    whole and repeat nobody. starts and ends are spans of word numbers. Other columns play no part.

    Windows of 9 words that repeat are found first; of those of 18, only ones both of whose halves repeat are counted; of
    those of 35, only ones whose first and last 18 words repeat. Windows are compared by hashes modulo 2**61 - 1.
    """
    texts = blocks(frame, key, text)
    plan = Plan(width, int(frame.agg(F.sum(F.octet_length(text))).first()[0] or 0))
    replies: list[DataFrame] = []
    for _ in plan.levels:
        replies.append(repeated(texts, replies, plan))
    count = len(replies)

    def run(batch):
        for row in range(batch.num_rows):
            block = Block(plan, batch, row)
            again = np.flatnonzero(block.repeated([batch.column(f"r{j}")[row].as_py() for j in range(count)]))
            edge = np.bincount(again, minlength=block.size + 1) - np.bincount(again + width, minlength=block.size + 1)
            covered = np.cumsum(edge[: block.size]) > 0
            gone = np.append(0, np.cumsum(covered))[block.at]
            kept, sizes, starts, ends = [], np.diff(block.at), [], []
            for i, a in enumerate(block.at[:-1]):
                some = block.data[block.offsets[i] : block.offsets[i + 1]].tobytes().split()
                if gone[i + 1] == gone[i]:
                    first = last = []
                else:
                    step = np.diff(np.concatenate([[0], covered[a : block.at[i + 1]].view(np.int8), [0]]))
                    first, last = np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()
                    some = [w for x, y in zip([0, *last], [*first, len(some)], strict=True) for w in some[x:y]]
                kept.append(b" ".join(some).decode())
                starts.append(first)
                ends.append(last)
            yield pa.RecordBatch.from_arrays([block.ids, pa.array(sizes, pa.int64()), pa.array(kept, pa.string()), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))], names=[key, "n_words", "kept", "starts", "ends"])

    return arrow_map(_with(texts, replies), run, f"`{key}` {frame.schema[key].dataType.simpleString()}, n_words bigint, kept string, starts array<int>, ends array<int>")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("bigint"), lambda t, x: t + x)
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
