"""Parts of the text operators against plain versions: Viterbi and gradient of the field, whole tokens and words, query columns of op8 to op10."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest

from concordia.llm import decontaminate, langid, neardup, pii, suffixarray, toxicity, windows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path, rng = str(tmp_path_factory.mktemp("small")), random.Random(21)
    say = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    shared = [say(45), say(60)]
    texts = [say(rng.randint(1, 30)) + " " + rng.choice([*shared, ""]) + "  " + say(rng.randint(0, 20)) for _ in range(40)]
    texts += [texts[0], texts[0], None, "", "aB " * 80, "z" * 350, texts[3][:-3], "É" * 120, "one two"]
    spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id bigint, text string, _id string").repartition(4).write.parquet(f"{path}/documents.parquet")
    return path, texts


WORDS = [a + b for a in "ba de ki lo mu na pe ri so tu".split() for b in "l n r s st m".split()]


def test_op8_columns(spark, folder):
    path, texts = folder
    seen, want = {}, {}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for a in range(len(data) - 99):
            if seen.setdefault(data[a : a + 100], (i, a)) != (i, a):
                gone[a : a + 100] = True
        runs = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        want[i] = (len(data), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(data, gone, strict=True) if not g)).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixarray.op8_suffix_array_dedup(spark, path).collect()}
    assert got == want and sum(x[2] for x in want.values()) > 20


def test_op9_columns(spark, folder):
    path, texts = folder
    each = [re.findall(r"[^\x20\x09-\x0d]+", t or "") for t in texts]
    count = {}
    for w in each:
        for a in range(len(w) - 34):
            count[tuple(w[a : a + 35])] = count.get(tuple(w[a : a + 35]), 0) + 1
    want = {}
    for i, w in enumerate(each):
        gone = [False] * len(w)
        for a in range(len(w) - 34):
            if count[tuple(w[a : a + 35])] > 1:
                gone[a : a + 35] = [True] * 35
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        want[i] = (len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in windows.op9_substring_dedup(spark, path).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 500


def test_op10_columns(spark, folder):
    path, texts = folder
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[a : a + 4]) for a in range(max(1, len(w) - 3))} if w else set())
    lead = list(range(len(texts)))
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in texts:
        for a, b in links:
            lead[a] = lead[b] = min(lead[a], lead[b])
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.op10_minhash_near_dedup(spark, path).collect()}
    assert got == {i: (len(s), lead[i], lead[i] == i) for i, s in enumerate(sets)} and len(set(lead)) < len(lead) - 2


def test_viterbi_against_all_paths():
    model, rng = pii.Field(rounds=3), np.random.default_rng(6)
    model.weights = rng.normal(0, 1, model.weights.shape)
    model.steps = rng.normal(0, 1, model.steps.shape)
    lines = ["ssn 078-05-1120 was listed", "call me on", "x", "tel 555-867-5309 or", "iban DE44500105175407324931 paid now"]
    for line, labels in zip(lines, model.decode([x.split() for x in lines]), strict=True):
        rows = [model.weights[[model.index.get(f, len(model.index)) for f in some]].sum(0) for some in pii.features(line.split())]
        score = lambda y, rows=rows: sum(r[k] for r, k in zip(rows, y, strict=True)) + sum(model.steps[a, b] for a, b in itertools.pairwise(y))
        assert labels == list(max(itertools.product(range(len(pii.LABELS)), repeat=len(rows)), key=score))


def test_training_climbs_the_likelihood():
    """The first step's direction is the gradient of the log-likelihood, found by differences."""
    line = "ssn 078-05-1120/i was call 555-0147/c 99/c now"
    tokens = [t[:-2] if t[-2:] in ("/c", "/i") else t for t in line.split()]
    gold = [0, 3, 0, 0, 1, 2, 0]

    def likelihood(weights, steps, index):
        rows = [weights[[index[f] for f in some]].sum(0) for some in pii.features(tokens)]
        total = lambda y: sum(r[k] for r, k in zip(rows, y, strict=True)) + sum(steps[a, b] for a, b in itertools.pairwise(y))
        return total(gold) - np.logaddexp.reduce([total(y) for y in itertools.product(range(5), repeat=len(rows))])

    zero = pii.Field(line, rounds=0)
    assert not zero.weights.any() and not zero.steps.any()
    one = pii.Field(line, rounds=1, rate=1e-4, decay=0.0)
    rng, small = random.Random(2), 1e-5
    for _ in range(6):
        f, k = rng.choice(list(zero.index)), rng.randrange(5)
        up, down = zero.weights.copy(), zero.weights.copy()
        up[zero.index[f], k] += small
        down[zero.index[f], k] -= small
        slope = (likelihood(up, zero.steps, zero.index) - likelihood(down, zero.steps, zero.index)) / (2 * small)
        assert np.sign(one.weights[zero.index[f], k]) == np.sign(slope) or abs(slope) < 1e-3
    a, b = 1, 2
    up, down = zero.steps.copy(), zero.steps.copy()
    up[a, b] += small
    down[a, b] -= small
    assert np.sign(one.steps[a, b]) == np.sign(likelihood(zero.weights, up, zero.index) - likelihood(zero.weights, down, zero.index))


def test_the_field_reads_whole_tokens_and_whole_words():
    long = "w" * 90
    text = f"one {long} passport number{'x' * 60} 1234 {long} after that"
    (only,) = pii.sequences(text)
    assert [text[a:b] for a, b in only] == ["passport", f"number{'x' * 60}", "1234", long, "after"]
    assert pii.shape("ab" * 30 + "99") == "aaaa99" and pii.shape("-".join(["1"] * 50)) == "-".join(["9"] * 50)
    d = [f for f in pii.features(["5" * 64])[0] if f.startswith("d=")]
    assert d == ["d=64"]
    rng = random.Random(4)
    for _ in range(200):
        t = "".join(rng.choice(["a", "b1", "@", " ", "  ", "\n", "word", "at", "dot", "(at)"]) for _ in range(30))
        spans = [s for some in pii.sequences(t) for s in some]
        assert spans == sorted(set(spans)) and all(re.fullmatch(r"\S+", t[a:b]) for a, b in spans)


FOUND = ["his SSN is {}.", "the claimant ({}) paid", "the man (ssn {}) came", "her social security number, {}, was"]


def test_numbers_before_full_stops_and_in_brackets_are_found():
    rng, model = random.Random(7), pii.field()
    number = lambda: f"{rng.randrange(100, 999)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}"
    for form in FOUND:
        for _ in range(25):
            n = number()
            text = form.format(n)
            (spans,) = pii.find_all([text], model)
            assert [text[a:b] for a, b, _ in spans] == [n], text
    plain = ["in 1984 there were 15 of 300.", "(a sum of 3.14159) is", "they won 3-2 (21-14) again", "on 2001-09-11."]
    assert pii.find_all(plain, model) == [[]] * len(plain)
    assert [text[slice(*pii.core(text, 0, len(text)))] for text in ("(212)", "(078-05-1120)", "x).", "(a", '"b",', "f(x)", ".")] == ["(212)", "078-05-1120", "x", "a", "b", "f(x)", "."]


def test_labels_of_one_kind_remove_nothing(spark):
    docs = spark.createDataFrame([(i, f"some words {i}", "x") for i in range(20)] + [(20, None, "x")], "doc_id bigint, text string, source string")
    for toxic in (0, 1):
        labels = spark.createDataFrame([(i, toxic) for i in range(10)], "doc_id bigint, toxic int")
        assert toxicity.remove_toxic(docs, labels).count() == 21
    assert toxicity.remove_toxic(docs, labels.limit(0)).count() == 21


def plain_tiling(item, text, least):
    """The longest common run of tokens not yet marked, the first in the item, then in the text, again and again."""
    free_i, free_j, out = [True] * len(item), [True] * len(text), []
    while True:
        best = (0, 0, 0)
        for i, j in itertools.product(range(len(item)), range(len(text))):
            k = 0
            while i + k < len(item) and j + k < len(text) and free_i[i + k] and free_j[j + k] and item[i + k] == text[j + k]:
                k += 1
            best = max(best, (k, -i, -j))
        size, i, j = best[0], -best[1], -best[2]
        if size < least:
            return out
        out.append((i, j, size))
        free_i[i : i + size] = free_j[j : j + size] = [False] * size


def test_tiling_against_plain_and_its_growth():
    rng = random.Random(2)
    for _ in range(120):
        letters, least = rng.choice([1, 2, 3, 6, 30]), rng.choice([1, 2, 3, 5])
        item, text = ([rng.randrange(letters) for _ in range(rng.randint(0, n))] for n in (18, 28))
        assert decontaminate.tile(np.array(item, np.uint64), np.array(text, np.uint64), least) == plain_tiling(item, text, least)
    took = {}
    for n in (5000, 20_000):
        item = np.random.default_rng(1).integers(0, 1 << 40, n).astype(np.uint64)
        blocks = [item[a : a + 10] for a in range(0, n, 10)]
        rng.shuffle(blocks)
        began = time.process_time()
        tiles = decontaminate.tile(item, np.concatenate(blocks), 5)
        took[n] = time.process_time() - began
        assert sum(t[2] for t in tiles) == n
    assert took[20_000] < 2 or took[20_000] < 10 * took[5000]


def test_phrases_of_periodic_texts_and_their_growth():
    rng = random.Random(3)
    spell = {x: [("".join(rng.choice(a) for _ in range(rng.randint(2, 8)))) for _ in range(200)] for x, a in (("x", "abcdefgh"), ("y", "efghijkl"))}
    model = langid.Model({x: " ".join(rng.choice(w) for _ in range(1500)) for x, w in spell.items()})
    texts = ["a" * 5000, "ab" * 3000, "abc d" * 1500, " ".join(rng.choice(spell["x"]) for _ in range(1200)), "a" * 2600 + "b" * 2600 + "ef gh " * 700, "z" * 700, "a"]
    got, _ = model.phrases(texts)
    for text, row in zip(texts, got, strict=True):
        symbols = model.read([text])[0].tolist()
        for (step, first), share in zip(model.tables, row, strict=True):
            state = many = 0
            for c in symbols:
                cell = int(step[state + c])
                many += cell >> 32 != state
                state = int(first[c]) if cell >> 32 != state else cell & 0xFFFFFFFF
            assert share == pytest.approx((many + 1) / len(symbols))
    began = time.process_time()
    model.phrases(["a" * 1_000_000])
    assert time.process_time() - began < 10  # once a minute
