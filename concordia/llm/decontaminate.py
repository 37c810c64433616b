"""Benchmark decontamination by greedy string tiling over token seeds shared with benchmark items."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import LOWER, MARKS, Spans, arrow_map, chunks, fresh, ragged, span_hashes, table, utf8, window_hashes, words

#: Tokens of the shortest tile; an item with fewer is one tile as a whole.
TILE = 5
#: Share of an item's tokens that tiles in one text must cover.
COVERAGE = 0.5
#: Tokens of the shortest item for which decontaminate() removes a text; contaminated() reports shorter ones as well.
LEAST = 5
#: Bytes of benchmark text that one pass over the texts holds against them; a larger benchmark takes more passes.
BLOCK_BYTES = 4_000_000
_TILES = "array<struct<item_start:int,text_start:int,length:int>>"


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of lower-cased tokens (runs of letters and digits) of concatenated texts, and the offsets of each text."""
    low = LOWER[data]
    starts, ends, at = words(low, offsets, MARKS)
    return span_hashes(low, starts, ends), at


def tile(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: again and again the longest common run of tokens not yet marked, while it has `least` tokens.

    Of runs of one length, the first in the item, then in the text, is taken. Whether runs of a length are common is
    found by Karp-Rabin hashes of all unmarked windows, and the greatest length by bisection, as a common run holds
    shorter ones; then one sweep marks all tiles of that length, so there are as many searches as lengths, not as tiles.
    No pairs of places are made, however often a token repeats. What hashes find is compared token by token.
    """
    mine, other = Spans(item), Spans(text)
    open_i, open_j = np.ones(len(item), bool), np.ones(len(text), bool)

    def unmarked(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, hash) of the item's unmarked windows that the text may hold, and of the text's, in the order of their hash."""
        found = []
        for spans, open_ in ((mine, open_i), (other, open_j)):
            used = np.append(0, np.cumsum(~open_))
            start = np.flatnonzero(used[size:] == used[:-size]) if len(open_) >= size else np.zeros(0, np.int64)
            found.append((start, spans.of(start, start + size)))
        (i, x), (j, y) = found
        order = np.argsort(y, kind="stable")
        j, y = j[order], y[order]
        at = np.minimum(np.searchsorted(y, x), max(0, len(y) - 1))
        both = y[at] == x if len(y) else np.zeros(len(x), bool)
        return i[both], x[both], j, y

    def equal(i: int, j: int, size: int) -> bool:
        return bool((item[i : i + size] == text[j : j + size]).all())

    def common(size: int) -> bool:
        i, x, j, y = unmarked(size)
        ends = zip(i.tolist(), np.searchsorted(y, x).tolist(), np.searchsorted(y, x, "right").tolist(), strict=True)
        return any(equal(a, to, size) for a, low, high in ends for to in j[low:high].tolist())

    def sweep(size: int) -> list[tuple[int, int, int]]:
        """All tiles of a length, marked one after the other; a window that overlaps one is out."""
        i, x, j, y = unmarked(size)
        next_, high = np.searchsorted(y, x), np.searchsorted(y, x, "right").tolist()
        first = {h: int(n) for h, n in zip(x.tolist(), next_, strict=True)}  # of the windows of a hash, those before are out
        out_i, out_j, tiles = np.zeros(len(item), bool), np.zeros(len(text), bool), []
        for a, h, end in zip(i.tolist(), x.tolist(), high, strict=True):
            if out_i[a]:
                continue
            while first[h] < end and out_j[j[first[h]]]:
                first[h] += 1
            to = next((t for t in j[first[h] : end] if not out_j[t] and equal(a, t, size)), None)
            if to is not None:
                tiles.append((a, int(to), size))
                for out, open_, at in ((out_i, open_i, a), (out_j, open_j, to)):
                    out[max(0, at - size + 1) : at + size] = True
                    open_[at : at + size] = False
        return tiles

    out, most = [], min(len(item), len(text))
    while most >= least and common(least):
        low, high = least, most  # common at low; over high it isn't
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if common(mid) else (low, mid - 1)
        out += sweep(low)
        most = low - 1
    return out


class Items:
    """A block of benchmark items: their tokens and, by size, their seeds.

    Tiles of TILE tokens or more that cover c of an item's tokens begin c / TILE of its seeds or more. So a text that
    covers enough shares one of the item's seeds even if as many of them as that, less one, are left out: those that most
    items share, such as an opening phrase, lead from texts to items only where an item has hardly others.
    """

    def __init__(self, ids: list, texts: list[str], coverage: float):
        data, offsets = utf8(pa.array(texts, pa.string()))
        hashes, at = tokens(data, offsets)
        self.ids, self.tokens = ids, [hashes[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        self.seeds = {}
        self.windows = [window_hashes(x, min(TILE, len(x))) if len(x) else x for x in self.tokens]
        sizes = np.array([min(TILE, len(x)) for x in self.tokens], np.int64)
        for size in sorted({*sizes.tolist()} - {0}):
            some = np.flatnonzero(sizes == size)
            common, items = np.unique(np.concatenate([np.unique(self.windows[k]) for k in some]), return_counts=True)
            each = []
            for k in some:
                own = self.windows[k]
                shared = items[np.searchsorted(common, own)]
                spare = max(0, int(np.ceil(np.ceil(coverage * len(self.tokens[k])) / size)) - 1)
                each.append(np.unique(own[np.argsort(shared, kind="stable")[: max(1, len(own) - spare)]]))
            keys, owner = np.concatenate(each), np.repeat(some, [len(x) for x in each])
            order = np.argsort(keys, kind="stable")
            seen = np.zeros(1 << 20, bool)
            seen[keys & np.uint64(0xFFFFF)] = True
            self.seeds[size] = keys[order], owner[order], seen

    def match(self, hashes: np.ndarray, at: np.ndarray):
        """(text, item, tiles) of each pair with a shared seed."""
        for size, (keys, owner, seen) in self.seeds.items():
            windows = window_hashes(hashes, size)
            hits = np.flatnonzero(seen[windows & np.uint64(0xFFFFF)])
            hits = hits[np.isin(windows[hits], keys)]
            text = np.searchsorted(at, hits, "right") - 1
            inside = hits + size <= at[text + 1]
            hits, text = hits[inside], text[inside]
            cuts = np.append(np.flatnonzero(np.diff(text, prepend=-1)), len(text))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                t, first, last = int(text[a]), int(at[text[a]]), int(at[text[a] + 1])
                values = np.unique(windows[hits[a:b]])
                low, high = np.searchsorted(keys, values), np.searchsorted(keys, values, "right")
                for item in np.unique(owner[ragged(low, high - low)]).tolist():
                    own = windows[first : last - size + 1]
                    near = np.flatnonzero(np.isin(own, self.windows[item]))
                    marks = np.bincount(near, minlength=last - first + 1) - np.bincount(near + size, minlength=last - first + 1)
                    where = np.flatnonzero(np.cumsum(marks) > 0)  # a common run lies in shared seeds
                    gap = np.flatnonzero(np.diff(where) > 1) + 1
                    piece = np.insert(hashes[first + where], gap, np.arange(len(gap), dtype=np.uint64))
                    where = np.insert(where, gap, -1)
                    yield t, item, [(i, int(where[j]), n) for i, j, n in tile(self.tokens[item], piece, size)]


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item_key, n_tokens, n_covered, coverage, tiles) of each text and item whose tiles reach the coverage.

    Nulls and empty texts or items match nothing. Rows that repeat are judged each on its own. Tiles are in tokens and
    may come in any order, so passages put together anew are found. The benchmark is held against the texts in blocks
    of bounded size, each of which is sent to the executors; there is no shuffle.
    """
    spark, kind, item_kind = docs.sparkSession, docs.schema[key].dataType.simpleString(), benchmark.schema[item_key].dataType.simpleString()
    schema = f"`{key}` {kind}, `{item_key}` {item_kind}, n_tokens long, n_covered long, coverage double, tiles {_TILES}"
    benchmark = benchmark.select(item_key, item_text).filter(F.col(item_text).isNotNull())
    total = benchmark.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    blocks = total // BLOCK_BYTES + 1
    item_type = to_arrow_type(benchmark.schema[item_key].dataType)
    docs, parts = docs.select(key, text), []
    for k in range(blocks):
        rows = benchmark.filter(F.pmod(F.xxhash64(item_key, item_text), F.lit(blocks)) == k).collect()
        if rows:
            sent = spark.sparkContext.broadcast(Items([r[0] for r in rows], [r[1] for r in rows], coverage))

            def run(batch, sent=sent):
                items, column = sent.value, batch.column(1)
                data, offsets = utf8(column)
                for a, b in chunks(np.diff(offsets)):
                    hashes, at = tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    out = [(a + t, i, len(items.tokens[i]), sum(x[2] for x in tiles), tiles) for t, i, tiles in items.match(hashes, at)]
                    out = [x for x in out if x[3] >= coverage * x[2]]
                    if out:
                        row, item, n, covered, tiles = zip(*out, strict=True)
                        struct = pa.list_(pa.struct([("item_start", pa.int32()), ("text_start", pa.int32()), ("length", pa.int32())]))
                        tiles = pa.array([[dict(zip(("item_start", "text_start", "length"), x, strict=True)) for x in some] for some in tiles], struct)
                        share = [c / m for c, m in zip(covered, n, strict=True)]
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array([items.ids[i] for i in item], item_type), pa.array(n, pa.int64()), pa.array(covered, pa.int64()), pa.array(share), tiles], names=[key, item_key, "n_tokens", "n_covered", "coverage", "tiles"])

            parts.append(arrow_map(docs, run, schema))
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """docs without those that hold a benchmark item of LEAST tokens or more; rows with a null doc_id stay."""
    name = fresh(docs, "_bad")
    bad = contaminated(docs, benchmark, coverage).filter(F.col("n_tokens") >= LEAST).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, docs["doc_id"] == bad[name], "left_anti")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document that holds a benchmark item, with the item and the share of it that tiles cover."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_tokens", "n_covered", "coverage", F.size("tiles").cast("long").alias("n_tiles"))
