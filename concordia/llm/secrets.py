"""Secret scans: fixed patterns, and sliding-window entropy by character class over candidate strings."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, table

#: Window of the entropy, in characters, and by class of the candidate the bits a character that make a secret.
WINDOW, BITS = 20, {"hex": 3.2, "alphanumeric": 3.7, "base64": 3.9}
#: Candidates that hold one of these, in any case, are placeholders.
ALLOWED = ("example", "placeholder", "changeme", "dummy", "sample", "xxxx", "0123456789", "abcdefgh")
KINDS = ("assign", "access", "hex", "entropy")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS, _HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{32,}")
_DIGIT, _CANDIDATE = re.compile(r"[0-9]"), re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
#: A part of a path: a word in one case, perhaps with a capital, before or after a number, or a number.
_NAME = re.compile(r"[0-9]*(?:[A-Z]?[a-z]+|[A-Z]+)[0-9]*|[0-9]+")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Matches of the fixed patterns, by kind leftmost and not overlapping."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if _DIGIT.search(text) or _HEX.search(text):
        out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return out


def peak_entropy(text: str, window: int = WINDOW) -> float:
    """The highest Shannon entropy, in bits a character, of the windows of text; counts move with the window."""
    n = min(window, len(text))
    if not n:
        return 0.0
    weight = [0.0] + [c * math.log2(c) for c in range(1, n + 1)]
    counts: dict[str, int] = {}
    total = best = 0.0
    for i, c in enumerate(text):
        k = counts.get(c, 0)
        total += weight[k + 1] - weight[k]
        counts[c] = k + 1
        if i >= n:
            old = text[i - n]
            k = counts[old]
            total += weight[k - 1] - weight[k]
            counts[old] = k - 1
        if i >= n - 1:
            best = max(best, math.log2(n) - total / n)
    return best


def named(text: str) -> bool:
    """Whether most characters of text lie in parts like names of files: few changes between cases and digits."""
    parts = [p for p in re.split("[/_=+-]+", text) if p]
    return 2 * sum(len(p) for p in parts if _NAME.fullmatch(p)) > sum(map(len, parts))


def random_key(s: str) -> bool:
    """Whether s, with digits and letters, has a window as random as keys are, and isn't an allowed one."""
    if not _DIGIT.search(s) or not re.search("[A-Za-z]", s) or _UUID.fullmatch(s) or any(w in s.lower() for w in ALLOWED):
        return False
    kind = "hex" if re.fullmatch("[0-9a-f]+|[0-9A-F]+", s) else "alphanumeric" if s.isalnum() else "base64"
    return peak_entropy(s) >= BITS[kind]


def entropy_spans(text: str) -> list[tuple[int, int, str]]:
    """Candidates that are random keys; of one that is a path, the parts between slashes that are."""
    out = []
    if not _DIGIT.search(text):
        return out
    for m in _CANDIDATE.finditer(text):
        parts = [m.span()]
        if m[0].count("/") > 2 and named(m[0]):
            parts = [(m.start() + p.start(), m.start() + p.end()) for p in re.finditer("[^/]{20,}", m[0]) if not named(p[0])]
        out += [(a, b, "entropy") for a, b in parts if random_key(text[a:b])]
    return out


def find(text: str) -> list[tuple[int, int, str]]:
    """All spans by start, then kind; one that the method adds lies in no fixed one."""
    base = base_spans(text)
    starts, reach = reaching(base)
    more = [x for x in entropy_spans(text) if not ((k := bisect_right(starts, x[0])) and reach[k - 1] >= x[1])]
    return sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2])))


def reaching(spans: list[tuple[int, int, str]]) -> tuple[list[int], list[int]]:
    """The starts of spans, in order, and how far those up to each reach."""
    spans = sorted(spans)
    return [x[0] for x in spans], list(accumulate((x[1] for x in spans), max))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(frame: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans array<struct<kind,start,end>>) of every row, in code points, end exclusive.

    Null and empty texts have no spans; repeated rows give a row each; whole texts are scanned.
    """
    frame = frame.select(key, text)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batch):
        spans = [[{"kind": k, "start": a, "end": b} for a, b, k in find(x)] if x else [] for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=[key, "spans"])

    return arrow_map(frame, run, f"`{key}` {frame.schema[key].dataType.simpleString()}, spans array<struct<kind:string,start:int,end:int>>")


def digest(spans: DataFrame, kinds: tuple[str, ...], base: tuple[str, ...], key: str = "doc_id") -> DataFrame:
    """Counts by base kind, the hash of the base spans, and all spans as text, from a scan's spans."""
    names = [f"n_{k}" for k in base]

    def run(batch):
        rows = [[(s["start"], s["end"], s["kind"]) for s in some] for some in batch.column(1).to_pylist()]
        own = [[s for s in some if s[2] in base] for some in rows]
        counts = [pa.array([sum(s[2] == k for s in some) for some in own], pa.int64()) for k in base]
        sha = pa.array([hashlib.sha256(joined(some).encode()).hexdigest() for some in own])
        return pa.RecordBatch.from_arrays([batch.column(0), *counts, sha, pa.array([joined(some) for some in rows])], names=[key, *names, "base_sha256", "spans"])

    return arrow_map(spans, run, f"`{key}` {spans.schema[key].dataType.simpleString()}, {', '.join(f'{n} long' for n in names)}, base_sha256 string, spans string")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(table(spark, sf_dir, "documents")), KINDS, KINDS[:3])
