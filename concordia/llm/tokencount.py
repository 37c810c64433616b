"""Token counts of whole texts: a broadcast table gives the lengths of frequent pre-tokens, worker caches those of the rest."""

from __future__ import annotations

import collections
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import CHUNK_BYTES, arrow_map, chunks, mix, table, utf8

#: The table is filled from so many texts at most, chosen by hash, of so many bytes each and in all; it holds so many pre-tokens.
#: What it holds decides how fast a pre-token is counted, never what is counted.
TEXTS, LONGEST, TOTAL, ENTRIES = 4000, 20_000, 6_000_000, 1 << 16
#: Pre-tokens of up to so many 8-byte words fit in the table; longer ones go to the caches.
WORDS = 3
#: Pre-tokens that a worker's cache holds before it starts anew, and the bytes of the longest that it holds.
CACHED, CACHED_BYTES = 400_000, 256
#: The mark between texts, and code points that stand for a letter, a number, another mark and a blank.
BREAK, STAND_IN = 0x110000, {bpe.LETTER: ord("b"), bpe.NUMBER: ord("1"), bpe.OTHER: ord("!"), bpe.BLANK: 9}
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def words_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(WORDS, and the size) of each span of bytes: equal rows, equal spans, for spans of up to 8 * WORDS bytes."""
    padded = np.concatenate([data, np.zeros(8 * WORDS, np.uint8)])
    view = np.ndarray((len(padded) - 7,), "<u8", padded.tobytes(), strides=(1,))
    size = ends - starts
    out = np.empty((len(starts), WORDS + 1), np.uint64)
    for k in range(WORDS):
        out[:, k] = view[starts + 8 * k] & _MASKS[np.clip(size - 8 * k, 0, 8)]
    out[:, WORDS] = size
    return out


def hashed(rows: np.ndarray) -> np.ndarray:
    h = rows[:, WORDS].copy()
    for k in range(WORDS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return h


class Lengths:
    """An open-addressed table from pre-tokens to numbers of tokens; a free slot has size nought."""

    def __init__(self, pieces: list[bytes], counts: list[int]):
        slots = 1 << max(4, (2 * len(pieces)).bit_length())
        self.mask = np.uint64(slots - 1)
        self.rows, self.counts = np.zeros((slots, WORDS + 1), np.uint64), np.zeros(slots, np.int32)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(x) for x in pieces], dtype=np.int64)
        rows = words_of(data, ends - [len(x) for x in pieces], ends) if pieces else np.zeros((0, WORDS + 1), np.uint64)
        for row, at, n in zip(rows, (hashed(rows) & self.mask).tolist(), counts, strict=True):
            while self.rows[at, WORDS]:
                at = (at + 1) % slots
            self.rows[at], self.counts[at] = row, n

    def find(self, rows: np.ndarray) -> np.ndarray:
        """The number of tokens of each row, -1 where the table doesn't hold it."""
        out = np.full(len(rows), -1, np.int64)
        slot = hashed(rows) & self.mask
        hold = self.rows[slot]
        same = (hold == rows).all(1)
        out[same] = self.counts[slot[same]]
        left = np.flatnonzero(~same & (hold[:, WORDS] > 0))
        while len(left):
            slot[left] = (slot[left] + np.uint64(1)) & self.mask
            hold = self.rows[slot[left]]
            same = (hold == rows[left]).all(1)
            out[left[same]] = self.counts[slot[left[same]]]
            left = left[~same & (hold[:, WORDS] > 0)]
        return out


def printable() -> dict[int, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else the next from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = [b for b in range(256) if b not in plain]
    return {b: 256 + k for k, b in enumerate(other)}


class Counter:
    """Counts tokens as a byte-level BPE file (.json) of the tokenizers library does; made on the driver and broadcast.

    Strings of added tokens count as one token each, wherever they stand, as is the library's default.
    """

    def __init__(self, spec: str):
        self.spec = spec
        kind = json.loads(spec)
        pre = kind["pre_tokenizer"] or {}
        added = kind["added_tokens"]
        if kind["model"]["type"] != "BPE" or kind["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or kind["model"].get("dropout") or any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in added):
            raise ValueError("a byte-level BPE file without normalizer, prefix blank and added tokens that take blanks along is wanted")
        self.added = sorted((x["content"] for x in added), key=len, reverse=True)
        self.lengths = Lengths([], [])
        self.odd, self.instead = self._unlike()
        self._start()

    def _start(self) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(self.spec).model
        self.cache: dict[bytes, int] = {}
        self.signs = printable()
        self.split = re.compile("|".join(map(re.escape, self.added))) if self.added else None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("model", "cache", "signs", "split")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._start()

    def _unlike(self) -> tuple[np.ndarray, np.ndarray]:
        """Code points whose class in the library's tables differs from that in bpe.classes(), and what stands for each.

        The library cuts the sequence of all code points where classes change, so one probe a run tells its class.
        """
        from tokenizers import Tokenizer

        cut = lambda text: [x for _, x in pre.pre_tokenize_str(text)]
        pre = Tokenizer.from_str(self.spec).pre_tokenizer
        codes = np.array([*range(0x80, 0xD800), *range(0xE000, 0x110000)])
        every = "".join(map(chr, codes.tolist()))
        kinds = np.empty(len(codes), np.uint8)
        for a, b in cut(every):
            probe = [k for k, before in ((bpe.LETTER, "a"), (bpe.NUMBER, "1"), (bpe.OTHER, "!")) if len(cut(before + every[a])) == 1]
            kinds[a:b] = probe[0] if probe else bpe.BLANK
        rows = np.flatnonzero(kinds != bpe.classes()[codes])
        return codes[rows].astype(np.uint32), np.array([STAND_IN[k] for k in range(4)], np.uint32)[kinds[rows]]

    def pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, starts, ends, owner, added) of the pre-tokens of texts, and how many added tokens each text holds."""
        parts, owner, extra = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            own = self.split.split(text) if self.split and any(x in text for x in self.added) else [text]
            extra[i] = len(own) - 1
            parts += own
            owner += [i] * len(own)
        joined = "\0".join([*parts, ""])
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).copy()
        breaks = np.cumsum([len(x) + 1 for x in parts], dtype=np.int64) - 1
        wide = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
        at = np.append(0, np.cumsum(wide))
        if len(self.odd):
            some = np.flatnonzero(codes >= self.odd[0])
            where = np.minimum(np.searchsorted(self.odd, codes[some]), len(self.odd) - 1)
            wrong = self.odd[where] == codes[some]
            codes[some[wrong]] = self.instead[where[wrong]]
        codes[breaks] = BREAK
        starts = np.flatnonzero(bpe.pre_tokens(codes))
        ends = np.append(starts[1:], len(codes))
        real = codes[starts] != BREAK
        starts, ends = starts[real], ends[real]
        mine = np.array(owner, np.int64)[np.searchsorted(breaks, starts)]
        return np.frombuffer(joined.encode(), np.uint8), at[starts], at[ends], mine, extra

    def tokens(self, piece: bytes) -> int:
        n = self.cache.get(piece)
        if n is None:
            n = len(self.model.tokenize(piece.decode("latin-1").translate(self.signs)))
            if len(piece) <= CACHED_BYTES:
                if len(self.cache) >= CACHED:
                    self.cache.clear()
                self.cache[piece] = n
        return n

    def count(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        data, starts, ends, owner, out = self.pieces(texts)
        n = np.full(len(starts), -1, np.int64)
        short = np.flatnonzero(ends - starts <= 8 * WORDS)
        n[short] = self.lengths.find(words_of(data, starts[short], ends[short]))
        rest = np.flatnonzero(n < 0)
        whole = data.tobytes()
        n[rest] = [self.tokens(whole[a:b]) for a, b in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)]
        total = np.append(0, np.cumsum(n))
        first = np.searchsorted(owner, np.arange(len(texts) + 1))
        return out + np.diff(total[first])

    def learn(self, texts: list[str]) -> Counter:
        """Fills the table with the commonest pre-tokens of texts; without texts it stays empty."""
        seen: collections.Counter = collections.Counter()
        for a, b in chunks(np.array([len(x) for x in texts])):
            data, starts, ends, *_ = self.pieces(texts[a:b])
            whole = data.tobytes()
            seen.update(whole[i:j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True) if j - i <= 8 * WORDS)
        common = [x for x, _ in seen.most_common(ENTRIES)]
        self.lengths = Lengths(common, [self.tokens(x) for x in common])
        self.cache = {}
        return self


def sampled(frame: DataFrame, key: str, text: str) -> list[str]:
    """Some texts, chosen by a hash of key and text: a bounded number of bounded size, wherever they stand."""
    n = frame.count()
    if not n:
        return []
    order = F.xxhash64(F.lit("tokens"), F.col(key).cast("string"), text)
    some = frame.filter(F.col(text).isNotNull() & (F.octet_length(text) <= LONGEST) & (F.pmod(order, F.lit(1 << 30)) < min(1.0, 4 * TEXTS / n) * (1 << 30)))
    texts, size = [], 0
    for (x,) in some.orderBy(order).select(text).limit(TEXTS).collect():
        size += len(x)
        if size <= TOTAL:
            texts.append(x)
    return texts


def token_counts(frame: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row: UTF-8 bytes and tokens of the whole text, and whether tokens exceed limit.

    A null text counts as empty: no bytes, no tokens. Rows that repeat and null keys give a row each, an empty table none;
    other columns play no part. Pre-tokens are counted where the text is: nothing of them is shuffled.
    """
    frame = frame.select(key, text)
    with open(path, encoding="utf-8") as file:
        counter = Counter(file.read()).learn(sampled(frame, key, text))
    sent = frame.sparkSession.sparkContext.broadcast(counter)  # bounded by ENTRIES and the vocabulary file

    def run(batch):
        column = batch.column(1)
        _, at = utf8(column)
        texts = [x or "" for x in column.to_pylist()]
        out = [sent.value.count(texts[a:b]) for a, b in chunks(np.diff(at), CHUNK_BYTES // 2)]
        n = np.concatenate(out)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at)), pa.array(n), pa.array(n > limit)], names=[key, "n_bytes", "n_tokens", "over_limit"])

    return arrow_map(frame, run, f"`{key}` {frame.schema[key].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by byte_bpe_50k.json, and those of over 512."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 512)
