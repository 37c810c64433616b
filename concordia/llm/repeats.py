"""What the two exact repeat removers share: anchors of windows, pieces of text around repeated anchors, and spans to remove.

A window of `width` units (bytes or words) owns one of its grams, the one of the smallest hash, its anchor. Equal windows
own equal grams at equal distance, so a window can only repeat if its anchor does. Neighbouring windows mostly own the
same gram; together they are a piece of text. Only pieces whose anchor repeats go on, keyed by a context, a run of about
half a window that all windows of the piece hold: this tells short common lines apart before anything is compared.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASES, anchors, arrow_map, chunks, keep, quick_windows, span_hashes, stored_bytes, utf8

#: Stored bytes of a side that is broadcast, and rows of one that holds keys alone; beyond, the join is a shuffled one.
SENT_BYTES, SENT_ROWS = 16_000_000, 400_000


@dataclass(frozen=True)
class Scheme:
    """width: units of a window; gram: units of an anchor; context: units of the run that keys a piece; read: (data, offsets) of texts as (units, offsets)."""

    width: int
    gram: int
    context: int
    read: Callable

    def runs(self, units: np.ndarray, at: np.ndarray):
        """Of each run of windows with one anchor: text, first window, windows, anchor's place; and the anchors' hashes."""
        grams = quick_windows(units, self.gram)
        low = anchors(grams, self.width - self.gram + 1)
        text = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(low)]
        good = np.flatnonzero(np.arange(len(low)) + self.width <= at[text + 1]) if len(low) else np.zeros(0, np.int64)
        place = low[good]
        new = np.ones(len(good), bool)
        new[1:] = (place[1:] != place[:-1]) | (np.diff(good) != 1)
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(good)))
        return text[good[first]], good[first], count, place[first].astype(np.int64), grams


def as_long(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def repeated_anchors(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """(_id, hashes array<bigint>): for each key the anchors of its text that also are anchors elsewhere, or twice in it."""

    def run(batch):
        data, offsets = utf8(batch.column(1))
        for a, b in chunks(np.diff(offsets)):
            units, at = scheme.read(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            text, _, _, place, grams = scheme.runs(units, at)
            h = grams[place] & np.uint64((1 << 48) - 1)  # fewer bits, less to shuffle: what meets by chance is told apart later
            order = np.lexsort((h, text))
            h, text = h[order], text[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(h)))
            yield pa.RecordBatch.from_arrays([as_long(h[first]), batch.column(0).take(pa.array(a + text[first])), pa.array(np.minimum(count, 2).astype(np.int32))], names=["h", "_id", "n"])

    found = keep(arrow_map(docs.select("_id", "_text").dropna(), run, f"h bigint, _id {docs.schema['_id'].dataType.simpleString()}, n int"))
    twice = found.groupBy("h").agg(F.sum("n").alias("all")).filter("all > 1").select("h")
    return found.select("h", "_id").join(twice, "h").groupBy("_id").agg(F.collect_list("h").alias("hashes"))


def sized_join(docs: DataFrame, side: DataFrame, keys: list[str], how: str) -> DataFrame:
    """docs joined with a side, broadcast if it has few stored bytes, or, if it holds keys alone, few rows; else shuffled."""
    small = stored_bytes(side) <= SENT_BYTES if set(side.columns) - set(keys) else side.limit(SENT_ROWS + 1).count() <= SENT_ROWS
    return docs.join(F.broadcast(side) if small else side, keys, how)


def pieces(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """(ctx, own, _id, _hash, start, windows, again) of each piece with a repeated anchor, written to the shared folder.

    ctx is the hash of its context, own that of its whole content, _hash the text's, start its first unit. Where a text
    holds a piece's content again, the later ones are marked `again`.
    """
    repeated = keep(repeated_anchors(docs, scheme))
    near = sized_join(docs, repeated.select("_id"), ["_id"], "left_semi").join(repeated, "_id")
    near = near.select("_id", "_text", "_hash", "hashes")
    half, tail = scheme.context, scheme.width - scheme.context

    def run(batch):
        data, offsets = utf8(batch.column(1))
        lists = batch.column(3)
        for a, b in chunks(np.diff(offsets)):
            units, at = scheme.read(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            text, first, count, place, grams = scheme.runs(units, at)
            h = (grams[place] & np.uint64((1 << 48) - 1)).view(np.int64)
            part = lists.slice(a, b - a)
            mine = np.zeros(len(h), bool)
            bounds = np.searchsorted(text, np.arange(b - a + 1))
            flat, ends = part.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(part.value_lengths().to_numpy(zero_copy_only=False)))
            for i in range(b - a):
                mine[bounds[i] : bounds[i + 1]] = np.isin(h[bounds[i] : bounds[i + 1]], flat[ends[i] : ends[i + 1]])
            text, first, count, place = text[mine], first[mine], count[mine], place[mine]
            # windows that hold the context right of the anchor's start, and those further left, which hold the one left of its end
            cut = np.clip(place - tail, first, first + count)
            rows = []
            for lo, n, start in ((cut, first + count - cut, place), (first, cut - first, place + scheme.gram - half)):
                use = n > 0
                rows.append((text[use], lo[use], n[use], span_hashes(units, start[use], start[use] + half)))
            text, lo, n, ctx = (np.concatenate(x) for x in zip(*rows, strict=True))
            own = span_hashes(units, lo, lo + n + scheme.width - 1, BASES[1])
            order = np.lexsort((lo, own, ctx, text))
            text, lo, n, ctx, own = text[order], lo[order], n[order], ctx[order], own[order]
            again = np.zeros(len(text), bool)
            again[1:] = (text[1:] == text[:-1]) & (ctx[1:] == ctx[:-1]) & (own[1:] == own[:-1])
            take = pa.array(a + text)
            yield pa.RecordBatch.from_arrays([as_long(ctx), as_long(own), batch.column(0).take(take), batch.column(2).take(take), pa.array((lo - at[text]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(again)], names=["ctx", "own", "_id", "_hash", "start", "windows", "again"])

    return keep(arrow_map(near, run, f"ctx bigint, own bigint, _id {docs.schema['_id'].dataType.simpleString()}, _hash bigint, start int, windows int, again boolean"))


def fetched(docs: DataFrame, wanted: DataFrame, scheme: Scheme, payload: Callable, kind: str) -> DataFrame:
    """wanted (ctx, _id, _hash, start, windows, n) with what `payload(units, starts, windows)` makes of each piece."""
    each = keep(wanted.groupBy("_id", "_hash").agg(F.collect_list(F.struct("ctx", "start", "windows", "n")).alias("pieces")))
    near = sized_join(docs, each.select("_id"), ["_id"], "left_semi").join(each, ["_id", "_hash"]).select("_id", "_text", "_hash", "pieces")

    def run(batch):
        data, offsets = utf8(batch.column(1))
        for a, b in chunks(np.diff(offsets)):
            units, at = scheme.read(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            part = batch.column(3).slice(a, b - a)
            text = np.repeat(np.arange(b - a), part.value_lengths().to_numpy(zero_copy_only=False))
            ctx, start, windows, n = part.flatten().flatten()
            lo, take = start.to_numpy() + at[text], pa.array(a + text)
            yield pa.RecordBatch.from_arrays([ctx, batch.column(0).take(take), batch.column(2).take(take), start, windows, n, payload(units, lo, windows.to_numpy().astype(np.int64))], names=["ctx", "_id", "_hash", "start", "windows", "n", "payload"])

    return arrow_map(near, run, f"ctx bigint, _id {docs.schema['_id'].dataType.simpleString()}, _hash bigint, start int, windows int, n bigint, payload {kind}")


def whole_copies(docs: DataFrame) -> DataFrame:
    """(_id, _hash, lead, bytes) of each text that more than one row holds, lead the smallest key among them."""
    each = docs.dropna().select("_id", "_hash", F.unhex(F.sha2("_text", 256)).alias("content"), F.octet_length("_text").alias("bytes"))
    many = each.groupBy("content").agg(F.min("_id").alias("lead"), F.count("*").alias("n")).filter("n > 1").select("content", "lead")
    return keep(each.join(many, "content").select("_id", "_hash", "lead", "bytes"))


def without(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """docs with one text of each group of copies; a row without key or text takes no part."""
    return sized_join(docs.dropna(), copies.filter("_id > lead").select("_id", "_hash").distinct(), ["_id", "_hash"], "left_anti")


def merged_spans(spans: DataFrame) -> DataFrame:
    """(_id, _hash, starts, ends) of each text, from rows (_id, _hash, a, b): spans that touch become one."""

    def run(batch):
        starts, ends = [], []
        for some in batch.column(2).to_pylist():
            some.sort()
            s, e = [], []
            for a, b in some:
                if e and a <= e[-1]:
                    e[-1] = max(e[-1], b)
                else:
                    s.append(a)
                    e.append(b)
            starts.append(s)
            ends.append(e)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))], names=["_id", "_hash", "starts", "ends"])

    grouped = spans.groupBy("_id", "_hash").agg(F.collect_set(F.array("a", "b")).alias("spans"))
    return keep(arrow_map(grouped, run, f"_id {spans.schema['_id'].dataType.simpleString()}, _hash bigint, starts array<int>, ends array<int>"))


def prepared(frame: DataFrame, key: str, text: str) -> DataFrame:
    """(_id, _text, _hash): the text's hash tells texts under one key apart."""
    return frame.select(F.col(key).alias("_id"), F.col(text).alias("_text")).withColumn("_hash", F.xxhash64("_text"))


