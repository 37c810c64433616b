"""op11 to op13 against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from concordia.llm import codes, importance, tokencount

SCHEMA = "doc_id bigint, text string, rank int, part string, _words int, n_bytes string"


def corpus(seed=11, n=70):
    rng = random.Random(seed)
    vocabulary = [a + b for a in "ba De ki LO mu né 日本 x9".split() for b in ["l", "N", "r7", "sso", "t" * 40, ""]]
    gaps = [" ", "  ", "\n", ", ", "-", "'s ", "\x00", "\x7f", "<|endoftext|>"]
    rows = [(i, "".join(rng.choice(vocabulary) + rng.choice(gaps) for _ in range(rng.choice([3, 19, 20, 40, 200])))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, "z" * 50_000), (n + 3, "ab " * 9000), (n + 4, " \t\n "), (n + 5, "<|endoftext|>"), (None, "no key " * 12), rows[4], rows[4]]
    return [(i, t, 1, "p", 2, "b") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


def plain_words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_resample(docs, target, percent, sizes, buckets, least, seed):
    def grams(text):
        w = plain_words(text)
        return [" ".join(w[i : i + k]) for k in sizes for i in range(len(w) - k + 1)]

    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x, *_ in docs]), (t, target)):
        for x in texts:
            for g in grams(x):
                counts[bucket(g)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    out = []
    for i, x, *_ in docs:
        own = grams(x)
        h = int(hashlib.sha256((f"{seed}:{i}" if i is not None else str(seed)).encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(g)] for g in own)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(plain_words(x))])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = k
    return sorted((tuple(-1 if x is None else x for x in r[:5]) for r in out))


@pytest.mark.parametrize(("percent", "sizes", "buckets"), [(10, range(1, 2), 10_000), (60, range(1, 4), 50)])
def test_resample(spark, docs, percent, sizes, buckets):
    target = ["bal ki ki nér7 x9", None, "", "日本 sso mul"]
    aim = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id int, text string")
    got = importance.resample(docs, aim, percent, sizes, buckets)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(tuple(-1 if x is None else x for x in r) for r in got.collect()) == plain_resample(corpus(), target, percent, sizes, buckets, 20, 2024)


def test_resample_of_nothing(spark, docs):
    assert importance.resample(docs.limit(0), docs, 10).count() == 0
    assert importance.resample(docs, docs.limit(0), 10).count() == docs.count()


def test_hash_and_interning():
    rng = random.Random(2)
    data = bytes(rng.randrange(3) for _ in range(4000))
    ends = np.cumsum([rng.randrange(1, 45) for _ in range(150)])
    starts = np.append(0, ends[:-1])
    raw = np.frombuffer(data, np.uint8)
    assert importance.xxhash64(raw, starts, ends).tolist() == [xxhash.xxh64_intdigest(data[a:b]) for a, b in zip(starts, ends, strict=True)]
    ends = np.minimum(starts + 3, len(data))
    seen = importance.Interned(raw, starts, ends, 97)
    content = [data[a:b] for a, b in zip(starts, ends, strict=True)]
    assert len({(c, s) for c, s in zip(content, seen.slot.tolist(), strict=True)}) == len(set(content)) == len(set(seen.slot.tolist()))
    assert all(seen.count[s] == content.count(c) and seen.bucket[s] == zlib.crc32(c) % 97 for c, s in zip(content, seen.slot.tolist(), strict=True))


def test_keys_that_meet_are_told_apart_by_their_bytes(monkeypatch):
    monkeypatch.setattr(importance, "xxhash64", lambda data, starts, ends: np.full(len(starts), 12, np.uint64))
    raw = np.frombuffer(b"abcabdabcxyzab", np.uint8)
    starts, ends = np.array([0, 3, 6, 9, 12]), np.array([3, 6, 9, 12, 14])
    seen = importance.Interned(raw, starts, ends, 7)
    assert seen.slot[0] == seen.slot[2] and len(set(seen.slot.tolist())) == 4 and seen.count.sum() == 5


def library(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    return [len(x.ids) for x in Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode_batch(texts, add_special_tokens=False)]


def test_token_counts(spark, docs):
    import public_tokenizers

    got = tokencount.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), 300)
    texts = [t or "" for _, t, *_ in corpus()]
    want = [(-1 if i is None else i, len(t.encode()), n, n > 300) for (i, *_), t, n in zip(corpus(), texts, library(texts), strict=True)]
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got.collect()) == sorted(want)
    assert tokencount.token_counts(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json"), 300).count() == 0


def test_token_counts_of_odd_texts(monkeypatch):
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        counter = tokencount.Counter(file.read())
    rng = random.Random(1)
    some = ["a", "b", "'s", "'re", "S", "tre", "v", "lm", " ", "  ", "\n", "\t", "\xa0", "1", "²", "é", "!", "日", "<|endoftext|>", "<|endo", "\x00", "՘", "࢏", "\U00010940", " ", "\x85", "wonderful" * 4]
    odd = ["".join(rng.choice([*some, chr(rng.randrange(0x100, 0xD800)), chr(rng.randrange(0xE000, 0x110000))]) for _ in range(50)) for _ in range(600)]
    want = library(odd)
    assert counter.count(odd).tolist() == want
    monkeypatch.setattr(tokencount, "CACHED", 5)
    assert counter.learn(odd[::2]).count(odd).tolist() == want  # with a filled table, and a cache that is emptied again and again
    assert counter.lengths.find(tokencount.words_of(np.frombuffer(b"never seen", np.uint8), np.array([0]), np.array([10]))).tolist() == [-1]


def plain_codes(rows, parts, entries, rounds):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max(max(len(v) for _, v, _ in kept), 1) // parts)
    kept = [(i, v + [0] * (parts * width - len(v)), label) for i, v, label in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    cut = lambda v: [v[j * width : (j + 1) * width] for j in range(parts)]
    books = [[cut(v)[j] for _, v, _ in first] for j in range(parts)]
    best = lambda p, book: min((sum((a - b) ** 2 for a, b in zip(p, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for j in range(parts):
            own = [(best(cut(v)[j], books[j])[1], cut(v)[j]) for _, v, _ in kept]
            books[j] = [[sum(x) // len(some) for x in zip(*some, strict=True)] if (some := [p for e, p in own if e == k]) else books[j][k] for k in range(len(first))]
    out = []
    for i, v, label in kept:
        found = [best(p, book) for p, book in zip(cut(v), books, strict=True)]
        out.append([i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label])
    sums = {label: sum(r[2] for r in out if r[3] == label) for *_, label in out}
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((-1 if i is None else i), c, e, sums[label], digest) for i, c, e, label in out)


def vectors(seed=4, n=150, width=8):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, rng.gauss(0, 1)]) for _ in range(width)], rng.choice([0, 1, None])) for i in range(n)]
    rows += [(n, None, 0), (n + 1, [None] * width, 1), (n + 2, [float("nan")] * width, 1), (n + 3, [float("inf")] * width, 1), (n + 4, [0.0] * width, None), (n + 5, [0.5] * 3, 5), (n + 6, [], 5), (None, [0.1] * width, 0), rows[3], rows[3]]
    return rows


@pytest.mark.parametrize(("parts", "entries", "rounds"), [(4, 8, 2), (3, 200, 1), (2, 5, 0)])
def test_codes(spark, parts, entries, rounds):
    frame = spark.createDataFrame([(*r, "x", 1) for r in vectors()], "vec_id bigint, embedding array<float>, label int, code string, reach int").repartition(4)
    got = codes.compress(frame, parts, entries, rounds)
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got.collect()) == plain_codes(vectors(), parts, entries, rounds)


def test_codes_of_nothing(spark):
    frame = spark.createDataFrame([(1, None, 2)], "vec_id bigint, embedding array<float>, label int")
    assert codes.compress(frame).collect() == []
    with pytest.raises(ValueError, match="exceed"):
        codes.compress(spark.createDataFrame([(1, [1e9], 2)], "vec_id bigint, embedding array<double>, label int"))


def test_pivots_prune():
    rng = np.random.default_rng(3)
    centres = rng.integers(-4000, 4000, (64, 4))
    points = centres[rng.integers(0, 64, 2000)] + rng.integers(-30, 30, (2000, 4))
    pivots = codes.pivot_rows(centres, codes.PIVOTS)
    entry, square, evaluated = codes.nearest(points, codes.roots(points, pivots), centres, pivots)
    every = ((points[:, None] - centres[None]) ** 2).sum(2)
    assert (entry == every.argmin(1)).all() and (square == every.min(1)).all() and evaluated < 0.15 * every.size
