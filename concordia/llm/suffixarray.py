"""Suffix-array dedup: bytes of strings that started earlier already go; suffix arrays by induced sorting decide."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, keep, ragged, table, utf8
from .repeats import Scheme, fetched, merged_spans, pieces, prepared, sized_join, whole_copies, without

#: Bytes of a string whose repeats go.
WIDTH = 100
SCHEME = Scheme(WIDTH, 32, 50, lambda data, offsets: (data, offsets))
#: Bytes of a shard's text, and pieces of one context beyond which its windows are grouped by content instead.
SHARD, HOT = 1_500_000, 20_000


def suffix_array(s: np.ndarray, depth: int = 1 << 30) -> np.ndarray:
    """The suffix array of s, whose last symbol is its smallest and occurs once, by induced sorting.

    Positions are classified as S (suffix smaller than the next) or L; the substrings between leftmost S positions get
    ranks, and the string of these ranks is sorted by pairs, then pairs of pairs (as far as `depth` symbols need); from
    these suffixes all others are induced, bucket by bucket, L upwards, then S downwards.
    """
    n = len(s)
    if n < 2:
        return np.arange(n)
    s = s.astype(np.int64)
    head = np.flatnonzero(np.append(True, s[1:] != s[:-1]))  # runs of a symbol have one type, by the next run
    up = np.append(s[head][1:] > s[head][:-1], True)
    small = np.repeat(up, np.diff(np.append(head, n)))
    left = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    order = left[_sorted_ranks(s, small, left, depth)]
    counts = np.bincount(s)
    ends = np.cumsum(counts)
    starts = ends - counts
    sa = np.full(n, -1)
    tails = np.bincount(s[order], minlength=len(counts))
    sa[np.repeat(ends - tails, tails) + ragged(np.zeros(len(tails), np.int64), tails)] = order
    symbols = np.flatnonzero(counts)
    front = starts.copy()

    def spread(j: np.ndarray, free: np.ndarray, step: int):
        """Puts positions into their buckets, in the order given, at the free ends."""
        to = np.argsort(s[j], kind="stable")
        j = j[to]
        sym = s[j]
        new = np.flatnonzero(np.append(True, sym[1:] != sym[:-1]))
        many = np.diff(np.append(new, len(j)))
        within = np.arange(len(j)) - np.repeat(new, many)
        sa[free[sym] + step * within] = j
        free[sym[new]] += step * many

    for c in symbols.tolist():
        done = starts[c]
        while done < front[c]:
            cur = sa[done : front[c]]
            done = front[c]
            j = cur - 1
            j = j[(j >= 0) & ~small[j]]
            if len(j):
                spread(j, front, 1)
        cur = sa[ends[c] - tails[c] : ends[c]] - 1
        cur = cur[cur >= 0]
        if len(cur):
            spread(cur, front, 1)
    back = ends - 1
    for c in symbols[::-1].tolist():
        done = ends[c] - 1
        while done > back[c]:
            cur = sa[back[c] + 1 : done + 1][::-1]
            done = back[c]
            j = cur - 1
            j = j[(j >= 0) & small[j]]
            if len(j):
                spread(j, back, -1)
        cur = sa[starts[c] : front[c]][::-1] - 1
        cur = cur[(cur >= 0) & small[cur]]
        if len(cur):
            spread(cur, back, -1)
        if c == symbols[0]:
            sa[starts[c]] = n - 1  # the end itself: the smallest suffix
    return sa


def _sorted_ranks(s: np.ndarray, small: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """The order of the suffixes that start at leftmost S positions."""
    m = len(left)
    size = np.append(np.diff(left) + 1, 1)
    typed = np.append(s * 2 + small, np.zeros(8, np.int64))
    bits = max(1, int(typed.max()).bit_length())
    per = 62 // bits

    def column(which: np.ndarray, at: int) -> np.ndarray:
        out = np.zeros(len(which), np.int64)
        for t in range(at, at + per):
            here = np.minimum(left[which] + t, len(typed) - 1)
            out = (out << bits) | np.where(t < size[which], typed[here] + 1 if bits * per < 62 else typed[here], 0)
        return out

    rank = np.unique(column(np.arange(m), 0), return_inverse=True)[1]
    at = per
    while at < size.max(initial=0):
        ties = np.bincount(rank)[rank] > 1
        which = np.flatnonzero(ties & (size > at))
        if not len(which):
            break
        more = np.zeros(m, np.int64)
        more[which] = np.unique(column(which, at), return_inverse=True)[1] + 1
        rank = np.unique(rank * (int(more.max()) + 1) + more, return_inverse=True)[1]
        at += per
    reach = 1
    while rank.max(initial=0) + 1 < m and reach < depth:
        nxt = np.zeros(m, np.int64)
        nxt[: m - reach] = rank[reach:] + 1
        rank = np.unique(rank * (m + 1) + nxt, return_inverse=True)[1]
        reach *= 2
    return np.argsort(rank, kind="stable")


def common_prefixes(s: np.ndarray, sa: np.ndarray, stop: int) -> np.ndarray:
    """For each position the symbols its suffix shares with the one before it in sa; symbols up to stop equal nothing.

    Only where the symbols before both differ are symbols compared; elsewhere it is one less than one position earlier.
    """
    n = len(s)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    i = np.arange(n)
    prev = np.where(i > 0, s[i - 1], -1)
    prev_b = np.where(before > 0, s[np.maximum(before - 1, 0)], -2)
    bare = (before >= 0) & ((prev != prev_b) | (prev <= stop))
    out = np.full(n, -1)
    at = np.flatnonzero(bare)
    out[at] = 0
    a, b, k = at, before[at], at
    t = 0
    while len(k):
        ok = (a + t < n) & (b + t < n)
        a, b, k = a[ok], b[ok], k[ok]
        same = (s[a + t] == s[b + t]) & (s[a + t] > stop)
        a, b, k = a[same], b[same], k[same]
        t += 1
        out[k] = t
    reach = np.maximum.accumulate(np.where(out >= 0, out + i, 0))
    return np.where(before >= 0, np.maximum(reach - i, 0), 0)


def later_windows(texts: list[bytes], windows: np.ndarray, ids: np.ndarray, starts: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(piece, window) of each window of the pieces whose bytes also start at an earlier (id, start) among them."""
    sizes = np.array([len(x) + 1 for x in texts])
    first = np.cumsum(sizes) - sizes
    s = np.frombuffer(b"\0".join(texts) + b"\0\0", np.uint8).astype(np.int64) + 2
    s[first[1:] - 1] = 1
    s[-2:] = 1, 0
    sa = suffix_array(s, width)
    joins = common_prefixes(s, sa, 1)[sa] >= width
    group = np.cumsum(~joins)
    piece = np.repeat(np.arange(len(texts)), sizes)
    piece = np.append(piece, len(texts) - 1)[sa]
    within = sa - first[piece]
    use = (within < windows[piece]) & (np.bincount(group, minlength=group[-1] + 1)[group] > 1)
    group, piece, within = group[use], piece[use], within[use]
    where = starts[piece] + within
    order = np.lexsort((where, ids[piece], group))
    group, piece, within, where = group[order], piece[order], within[order], where[order]
    new = np.ones(len(group), bool)
    new[1:] = np.diff(group) != 0
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = (ids[piece] != ids[piece[lead]]) | (where != where[lead])
    return piece[later], within[later]


def _bytes_of(units: np.ndarray, starts: np.ndarray, windows: np.ndarray) -> pa.Array:
    sizes = windows + WIDTH - 1
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(units[ragged(starts, sizes)].tobytes())])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(_id, _hash, starts, ends): spans of bytes of each text that are covered by strings that start earlier."""
    copies = whole_copies(docs)
    docs = without(docs, copies)
    found = pieces(docs, SCHEME)
    end = (F.col("start") + F.col("windows") + (WIDTH - 1)).alias("b")
    # one content's first place; the others go whole
    fresh = found.filter("NOT again")
    each = keep(fresh.groupBy("ctx", "own").agg(F.min("_id").alias("src"), F.count("*").alias("copies")))
    later = fresh.join(each.filter("copies > 1"), ["ctx", "own"]).filter("_id > src").unionByName(found.filter("again"), allowMissingColumns=True)
    spans = later.select("_id", "_hash", F.col("start").alias("a"), end)
    spans = spans.unionByName(copies.filter(f"_id > lead AND bytes >= {WIDTH}").select("_id", "_hash", F.lit(0).alias("a"), F.lit((1 << 31) - 1).alias("b")))
    # different contents around one context: the first of each goes into suffix arrays
    mixed = each.groupBy("ctx").agg(F.count("*").alias("n")).filter("n > 1")
    firsts = each.join(mixed, "ctx").join(fresh.select("ctx", "own", F.col("_id").alias("src"), "_hash", "start", "windows"), ["ctx", "own", "src"])
    firsts = keep(fetched(docs, firsts.select("ctx", F.col("src").alias("_id"), "_hash", "start", "windows", "n"), SCHEME, _bytes_of, "binary"))

    def shards(batches):
        held: list[pa.RecordBatch] = []
        size = 0

        def solve(t: pa.Table):
            ids, starts = t.column("_id").to_numpy(), t.column("start").to_numpy().astype(np.int64)
            piece, within = later_windows(t.column("payload").to_pylist(), t.column("windows").to_numpy(), ids, starts)
            order = np.lexsort((within, piece))
            piece, within = piece[order], within[order]
            new = np.ones(len(piece), bool)
            new[1:] = (np.diff(piece) != 0) | (np.diff(within) != 1)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(piece)) - 1
            if len(first):
                a, b = starts[piece[first]] + within[first], starts[piece[last]] + within[last] + WIDTH
                take = pa.array(piece[first])
                yield pa.RecordBatch.from_arrays([t.column("_id").combine_chunks().take(take), t.column("_hash").combine_chunks().take(take), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["_id", "_hash", "a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size > SHARD:  # all but the last context, which may go on
                t = pa.Table.from_batches(held)
                ctx = t.column("ctx").to_numpy()
                cut = int(np.searchsorted(-(ctx != ctx[-1]).astype(np.int8), 0)) if (ctx != ctx[-1]).any() else 0
                if cut:
                    yield from solve(t.slice(0, cut))
                held = t.slice(cut).to_batches()
                size = sum(x.nbytes for x in held)
        if held:
            yield from solve(pa.Table.from_batches(held))

    kind = f"_id {docs.schema['_id'].dataType.simpleString()}, _hash bigint, a int, b int"
    few = firsts.filter(F.col("n") <= HOT).select("ctx", "_id", "_hash", "start", "windows", "payload")
    parts = int(max(1, (firsts.agg(F.sum(F.length("payload"))).first()[0] or 0) // (4 * SHARD))) * 4
    sorted_ = few.repartition(max(parts, int(few.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "ctx").sortWithinPartitions("ctx")
    spans = spans.unionByName(sorted_.mapInArrow(shards, kind))
    many = firsts.filter(F.col("n") > HOT)
    each_window = many.select("_id", "_hash", "start", "payload", F.explode(F.sequence(F.lit(0), F.col("windows") - 1)).alias("k"))
    each_window = each_window.select("_id", "_hash", (F.col("start") + F.col("k")).alias("start"), F.unhex(F.sha2(F.expr(f"substring(payload, k + 1, {WIDTH})"), 256)).alias("content"))
    where = F.struct("_id", "start")
    lead = each_window.groupBy("content").agg(F.min(where).alias("lead"), F.count("*").alias("n")).filter("n > 1")
    late = each_window.join(lead, "content").filter(where != F.col("lead"))
    return merged_spans(spans.unionByName(late.select("_id", "_hash", F.col("start").alias("a"), (F.col("start") + WIDTH).alias("b"))))


def dedup(frame: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, kept binary, starts, ends) of every row: its text without bytes covered by a 100-byte string that also starts earlier.

    Earlier is a smaller key, or an earlier byte of the same text; equal rows of one key are no earlier than each other.
    Null texts count as empty; rows with a null key are kept whole and are nobody's earlier text. Cuts may fall within
    a character, so what is kept is bytes. Texts under 100 bytes stay.
    """
    docs = prepared(frame, key, text)
    spans = repeated_spans(docs)
    both = sized_join(docs, spans, ["_id", "_hash"], "left")
    both = both.select(F.col("_id").alias(key), "_text", "starts", "ends")

    def run(batch):
        data, offsets = utf8(batch.column(1))
        kept, sizes, ends = [], [], []
        for i, (a, b) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            own = data[offsets[i] : offsets[i + 1]]
            sizes.append(len(own))
            b = [min(x, len(own)) for x in b or []]
            kept.append(b"".join(own[x:y].tobytes() for x, y in zip([0, *b], [*(a or []), len(own)], strict=True)))
            ends.append(b)
        starts = [x or [] for x in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))], names=[key, "n_bytes", "kept", "starts", "ends"])

    return arrow_map(both, run, f"`{key}` {frame.schema[key].dataType.simpleString()}, n_bytes bigint, kept binary, starts array<int>, ends array<int>")


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
