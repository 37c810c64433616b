"""Byte-level BPE: a minimal perfect hash finds pre-tokens that are vocabulary entries; a heap over linked bytes merges the rest."""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, chunks, mix, ragged, span_hashes, table, utf8

#: Pre-tokens whose merges a worker remembers; it forgets all when it has so many.
MEMO = 600_000
LETTER, NUMBER, OTHER, BLANK, BREAK = range(5)


def load_ranks(path: str) -> list[bytes]:
    """The vocabulary of a rank file, by id."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    entries = [b""] * len(pairs)
    for token, rank in pairs:
        entries[int(rank)] = base64.b64decode(token)
    return entries


class PerfectHash:
    """Hash and displace: n keys fill n slots, one each; a key is found by one look at its bucket and one at its slot."""

    def __init__(self, keys: np.ndarray):
        n = self.n = max(1, len(keys))
        self.buckets = n // 2 + 1
        bucket = (keys % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        counts = np.bincount(bucket, minlength=self.buckets)
        first = np.cumsum(counts) - counts
        self.shift, taken = np.zeros(self.buckets, np.int64), np.zeros(n, bool)
        self.slot_of = np.zeros(len(keys), np.int64)
        for size in range(int(counts.max(initial=0)), 1, -1):  # the fullest buckets first; those of one size try a shift together
            left, shift = np.flatnonzero(counts == size), 0
            while len(left):
                shift += 1
                mine = order[first[left][:, None] + np.arange(size)]
                slots = self._slots(keys[mine], np.array(shift))
                _, at, many = np.unique(slots, return_inverse=True, return_counts=True)
                fits = ~(taken[slots] | (many[at.reshape(slots.shape)] > 1)).any(1)
                if not fits.any() and len(left) > 1:  # rivals: one of them alone
                    alone = ~taken[slots].any(1) & np.array([len(set(x)) == size for x in slots.tolist()])
                    fits[np.flatnonzero(alone)[:1]] = True
                self.shift[left[fits]], taken[slots[fits]] = shift, True
                self.slot_of[mine[fits]] = slots[fits]
                left = left[~fits]
        alone = order[first[counts == 1]] if len(keys) else order
        free = np.flatnonzero(~taken)[: len(alone)]
        self.shift[bucket[alone]] = -free - 1  # a lone key's slot is written down
        self.slot_of[alone] = free

    def _slots(self, keys: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (mix(keys + shift.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)) % np.uint64(self.n)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        shift = self.shift[(keys % np.uint64(self.buckets)).astype(np.int64)]
        return np.where(shift < 0, -shift - 1, self._slots(keys, np.maximum(shift, 0)))


@cache
def classes() -> np.ndarray:
    """The class of each code point."""
    out = np.full(0x110001, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
    out[0xD800:0xE000] = OTHER
    out[0x110000] = BREAK
    return out


def pre_tokens(codes: np.ndarray) -> np.ndarray:
    """Where pre-tokens start, as a mask; 0x110000 in codes stands between texts and is a pre-token of its own.

    A run of letters, of digits or of other marks takes one blank before it along; of other white space the last
    character stands alone before a run; an apostrophe that starts a pre-token takes s, t, re, ve, m, ll or d along.
    """
    kind = classes()[codes]
    n = len(codes)
    start = np.ones(n + 3, bool)
    start[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == BREAK)
    ends = np.flatnonzero((kind[:-1] == BLANK) & (kind[1:] < BLANK))
    start[ends] = True
    start[ends[codes[ends] == 32] + 1] = False
    quotes = np.flatnonzero((codes == 39) & start[:n])
    if len(quotes):
        padded = np.append(codes, [0x110000] * 3)
        one, two = padded[quotes + 1], padded[quotes + 2]
        short = quotes[np.isin(one, [ord(x) for x in "stmd"])]
        pair = np.zeros(len(quotes), bool)
        for a, b in ("re", "ve", "ll"):
            pair |= (one == ord(a)) & (two == ord(b))
        long = quotes[pair]
        for at, size in ((short, 2), (long, 3)):
            start[at + 1] = False
            start[at + size] = True
    return start[:n]


def merge(piece: bytes, rank) -> list[int]:
    """Merges the pair of lowest rank, leftmost first, until none is left: parts are linked, candidate pairs in a heap."""
    n = len(piece)
    bits = n.bit_length() + 1
    mask = (1 << bits) - 1
    stop, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r << 2 * bits) | (i << bits) | (i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        x = heapq.heappop(heap)
        i, e = (x >> bits) & mask, x & mask
        m = stop[i]
        if not m or m >= n or stop[m] != e:
            continue
        stop[i], stop[m] = e, 0
        if e < n:
            before[e] = i
            f = stop[e]
            if (r := rank(piece[i:f])) is not None:
                heapq.heappush(heap, (r << 2 * bits) | (i << bits) | f)
        if i:
            p = before[i]
            if (r := rank(piece[p:e])) is not None:
                heapq.heappush(heap, (r << 2 * bits) | (p << bits) | e)
    out, i = [], 0
    while i < n:
        out.append(rank(piece[i : stop[i]]))
        i = stop[i]
    return out


def unlike(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, like: np.ndarray) -> np.ndarray:
    """The spans whose codes differ from those of the span that `like` gives for each."""
    size = ends - starts
    same = size == (ends - starts)[like]
    rows = np.flatnonzero(same & (like != np.arange(len(like))))
    equal = codes[ragged(starts[rows], size[rows])] == codes[ragged(starts[like[rows]], size[rows])]
    wrong = np.bincount(np.repeat(rows, size[rows])[~equal], minlength=len(like)) > 0
    return np.flatnonzero(~same | wrong)


class Codec:
    """Encoder and decoder of one vocabulary; rank files are read where they are used, by path."""

    def __init__(self, path: str):
        entries = self.entries = load_ranks(path)
        self.rank = {x: i for i, x in enumerate(entries)}
        texts = {}
        for i, x in enumerate(entries):
            try:
                texts[x.decode()] = i
            except UnicodeDecodeError:
                pass  # never a whole pre-token
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(x) for x in texts])
        keys = span_hashes(codes, ends - [len(x) for x in texts], ends)
        self.hash = PerfectHash(keys)
        self.key_at, self.id_at = np.zeros(self.hash.n, np.uint64), np.zeros(self.hash.n, np.int64)
        self.key_at[self.hash.slot_of], self.id_at[self.hash.slot_of] = keys, list(texts.values())
        self.bytes = np.frombuffer(b"".join(entries), np.uint8)
        self.sizes = np.array([len(x) for x in entries], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.memo: dict[bytes, tuple[int, ...]] = {}

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts and the offsets of each text in them."""
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        sizes = np.array([len(x) for x in texts])
        codes = np.insert(codes, np.cumsum(sizes), 0x110000) if len(texts) else codes
        breaks = np.cumsum(sizes + 1) - 1
        starts = np.flatnonzero(pre_tokens(codes))
        ends = np.append(starts[1:], len(codes))
        real = codes[starts] != 0x110000
        first_of_text = np.searchsorted(starts[real], np.append(0, breaks + 1))
        starts, ends = starts[real], ends[real]
        keys, one, back = np.unique(span_hashes(codes, starts, ends), return_index=True, return_inverse=True)
        odd = unlike(codes, starts, ends, one[back])
        if len(odd):  # of one hash, but not of one content: each on its own
            back[odd] = len(one) + np.arange(len(odd))
            keys, one = np.append(keys, span_hashes(codes, starts[odd], ends[odd])), np.append(one, odd)
        slots = self.hash.find(keys)
        known = self.key_at[slots] == keys
        ids = [None] * len(keys)
        found = self.id_at[slots].tolist()
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo, rank, entries, whole = self.memo, self.rank.get, self.entries, "".join(texts)
        before = np.searchsorted(breaks, starts[one])  # marks between texts, which whole doesn't have
        for j, (hit, s, e) in enumerate(zip(known.tolist(), (starts[one] - before).tolist(), (ends[one] - before).tolist(), strict=True)):
            piece = whole[s:e].encode()
            if hit and entries[found[j]] == piece:
                ids[j] = (found[j],)
            elif (have := memo.get(piece)) is not None:
                ids[j] = have
            else:
                ids[j] = memo[piece] = tuple(merge(piece, rank))
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for some in ids for x in some), np.int64, int(counts.sum()))
        each = counts[back]
        out = flat[ragged((np.cumsum(counts) - counts)[back], each)]
        return out.astype("<u4"), np.append(0, np.cumsum(each))[first_of_text]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids and the offsets of each text in them."""
        each = self.sizes[ids]
        return self.bytes[ragged(self.first[ids], each)], np.append(0, np.cumsum(each))[offsets]


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def encode(frame: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every row. A null text counts as empty and has no ids; rows that repeat stay; other columns play no part."""
    frame = frame.select(key, text)
    kind = frame.schema[key].dataType.simpleString()

    def run(batch):
        texts = [x or "" for x in batch.column(1).to_pylist()]
        for a, b in chunks(np.array([len(x) for x in texts])):
            ids, offsets = codec(path).encode(texts[a:b])
            values = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), values], names=[key, "ids"])

    return arrow_map(frame, run, f"`{key}` {kind}, ids array<int>")


def decode(frame: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, data binary) of every row of encode(); null ids give empty data, an id outside the vocabulary is an error."""
    frame = frame.select(key, ids)
    kind = frame.schema[key].dataType.simpleString()

    def run(batch):
        column = batch.column(1)
        for row in range(batch.num_rows):
            own = np.array(column[row].as_py() or [], np.int64)
            data, _ = codec(path).decode(own, np.array([0]))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), pa.array([data.tobytes()])], names=[key, "data"])

    return arrow_map(frame, run, f"`{key}` {kind}, data binary")


def round_trip(frame: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): every text encoded, then its ids decoded, without storing either.

    Nulls count as empty texts: no tokens, and the hash of nothing. Repeated rows and keys give a row each.
    """
    frame = frame.select(key, text)
    kind = frame.schema[key].dataType.simpleString()

    def run(batch):
        texts = [x or "" for x in batch.column(1).to_pylist()]
        for a, b in chunks(np.array([len(x) for x in texts])):
            ids, offsets = codec(path).encode(texts[a:b])
            data, ends = codec(path).decode(ids, offsets)
            sha = lambda values, at: [hashlib.sha256(values[i:j]).hexdigest() for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(offsets)), pa.array(sha(ids, offsets)), pa.array(sha(data, ends))], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(frame, run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), vocabulary())
