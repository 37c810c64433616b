"""Language identification by cross-parsing: the language whose text needs the fewest phrases to spell a text wins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import LETTER, classes
from .common import arrow_map, chunks, crc32_mod, mix, table

#: Training text of a language: so many characters at most, in pieces of an eighth of that at most from anywhere in a
#: text, from so many different texts at most (chosen by hash), of such lengths first.
CHARACTERS, ROWS, LENGTHS = 24_000, 60, (20, 20_000)
#: Symbols of the blocks in which texts are parsed side by side; phrases go on from block to block.
BLOCK = 256
#: Laps after which parses that still don't meet are remembered by block, and how many are.
LAPS, REMEMBERED = 4, 100_000
UNKNOWN = "und"


def automaton(text: list[int], symbols: int) -> np.ndarray:
    """The suffix automaton of text as a table by state and symbol; the initial state is 0, -1 stands for no transition."""
    steps = transitions(text)
    out = np.full((len(steps), symbols), -1, np.int32)
    for state, own in enumerate(steps):
        if own:
            out[state, list(own)] = list(own.values())
    return out


def transitions(text: list[int]) -> list[dict[int, int]]:
    """The states of the suffix automaton of text, the initial one first: the next state by symbol."""
    steps, link, length = [{}], [-1], [0]
    last = 0
    for c in text:
        new = len(steps)
        steps.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in steps[p]:
            steps[p][c] = new
            p = link[p]
        if p != -1:
            q = steps[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(steps)
                steps.append(dict(steps[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and steps[p].get(c) == q:
                    steps[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return steps


def compact(steps: list[dict[int, int]]) -> np.ndarray:
    """Steps as one row of cells: a state is its base, its step by a symbol lies at base + symbol, as base << 32 | next base.

    Bases differ by state, the initial one's is 0; cells that no state uses hold -1. The size follows the steps, not
    states times symbols, so that any number of symbols fits.
    """
    used, taken, starts = bytearray(1), {0}, {}
    base = [0] * len(steps)

    def place(state):
        nonlocal used
        own = sorted(steps[state])
        at, tries = starts.get((own[0], len(own)), 0) if own else 0, 0
        while True:
            at = used.find(0, at)
            if at < 0:
                at = len(used)
                used += bytearray(max(1024, len(used) // 4))
            b = at - (own[0] if own else 0)
            if b >= 0 and (not state or b not in taken) and not any(b + c < len(used) and used[b + c] for c in own[1:]):
                break
            at, tries = at + 1, tries + 1
            if tries % 50 == 0 and own:
                starts[own[0], len(own)] = at  # leave crowded cells behind
        if own and b + own[-1] >= len(used):
            used += bytearray(b + own[-1] + 1024 - len(used))
        taken.add(b)
        base[state] = b
        for c in own:
            used[b + c] = 1

    used += bytearray(1024 + max(steps[0], default=0))
    for c in steps[0]:
        used[c] = 1
    for state in sorted(range(1, len(steps)), key=lambda i: -len(steps[i])):
        place(state)
    size = max(base) + 1 + max((max(x) for x in steps if x), default=0)
    out = np.full(size, -1, np.int64)
    for state, own in enumerate(steps):
        for c, to in own.items():
            out[base[state] + c] = base[state] << 32 | base[to]
    return out


def parsed(lanes: np.ndarray, step: np.ndarray, first_step: np.ndarray, goes_on: np.ndarray) -> np.ndarray:
    """Phrases that end in each block, a column of lanes, of greedy parses that run on where the next block goes on.

    All blocks are parsed at once, each as if a phrase began with it. Then each that goes on is parsed again from where
    the block before it ended, until a phrase ends where one of the first parse does, from where both are the same; if a
    block thus ends elsewhere, the next is parsed again, until none is. Text whose parses never meet, such as one letter
    over and over, repeats itself: what a block gave from a state is remembered, and a block of the same symbols isn't
    parsed again from that state.
    """
    count = lanes.shape[1]
    lost, state = np.zeros(lanes.shape, bool), np.zeros(count, np.int64)

    def advance(state: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = step.take(state + row)
        stop = cell >> 32 != state
        return np.where(stop, first_step.take(row), cell & 0xFFFFFFFF), stop

    for t, row in enumerate(lanes):
        state, lost[t] = advance(state, row)
    alone = np.cumsum(lost, 0, dtype=np.int32)
    first_end, last, ends = state, state.copy(), alone[-1].copy()
    todo = np.flatnonzero(goes_on) + 1
    for _ in range(LAPS):
        if not len(todo):
            return ends
        live, state, many = todo, last[todo - 1], np.zeros(len(todo), np.int32)
        was = last[todo]
        for t in range(len(lanes)):
            state, stop = advance(state, lanes[t, live])
            many += stop
            met = stop & lost[t, live]
            if met.any():
                done = live[met]
                ends[done] = many[met] + alone[-1, done] - alone[t, done]
                last[done] = first_end[done]
                live, state, many = live[~met], state[~met], many[~met]
                if not len(live):
                    break
        ends[live], last[live] = many, state
        moved = todo[last[todo] != was]
        moved = moved[moved < count - 1]
        todo = moved[goes_on[moved]] + 1
    if not len(todo):
        return ends
    # what is left is gone through block by block; equal symbols have equal marks, and that equal marks are of equal symbols is looked up
    mark = mix(lanes.astype(np.uint64) + np.uint64(1) + (np.arange(len(lanes), dtype=np.uint64) << np.uint64(32))[:, None]).sum(0)
    seen: dict[tuple[int, int], tuple[int, int, int]] = {}
    for block in todo.tolist():
        while True:
            key, before = (int(mark[block]), int(last[block - 1])), int(last[block])
            like = seen.get(key)
            if like is None or not (lanes[:, like[0]] == lanes[:, block]).all():
                state, many = key[1], 0
                for t, c in enumerate(lanes[:, block].tolist()):
                    cell = int(step[state + c])
                    stop = cell >> 32 != state
                    state, many = int(first_step[c]) if stop else cell & 0xFFFFFFFF, many + stop
                    if stop and lost[t, block]:
                        state, many = int(first_end[block]), many + int(alone[-1, block] - alone[t, block])
                        break
                like = block, many, state
                if len(seen) < REMEMBERED:
                    seen[key] = like
            ends[block], last[block] = like[1:]
            if last[block] == before or block == count - 1 or not goes_on[block]:
                break
            block += 1
    return ends


class Model:
    """Languages, the symbols of characters, and for each language the automaton of its text.

    Symbol 0 fills up blocks, 1 is any run of what isn't a letter, 2 a letter of no language's text, the rest are the
    letters of all texts, however many.
    """

    def __init__(self, texts: dict[str, str]):
        self.languages = sorted(texts)
        kinds = classes()
        counts: dict[str, int] = {}
        for text in texts.values():
            for c in text.lower():
                if kinds[ord(c)] == LETTER:
                    counts[c] = counts.get(c, 0) + 1
        known = sorted(counts, key=lambda c: (-counts[c], c))
        self.symbols = np.where(kinds == LETTER, 2, 1).astype(np.int32)
        for i, c in enumerate(known):
            self.symbols[ord(c)] = i + 3
            if len(c.upper()) == 1:
                self.symbols[ord(c.upper())] = i + 3
        self.width = len(known) + 3
        self.tables = [self._table(texts[x]) for x in self.languages]

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all texts, other characters between letters as one, and the text each belongs to."""
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        owner = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
        out = self.symbols[codes]
        once = np.ones(len(out), bool)
        once[1:] = (out[1:] != 1) | (out[:-1] != 1) | (owner[1:] != owner[:-1])
        return out[once], owner[once]

    def _table(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Where each base and symbol lead, filled up so that each base can take each symbol, and the steps of the initial state."""
        own = compact(transitions(self.read([text])[0].tolist()))
        own = np.append(own, np.full(self.width, -1))
        first = own[: self.width]
        return own, np.where(first >> 32 == 0, first & 0xFFFFFFFF, 0).astype(np.int32)

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases a symbol, by text and language, and which texts have letters."""
        read, owner = self.read(texts)
        n = len(texts)
        sizes = np.bincount(owner, minlength=n)
        blocks = -(-sizes // BLOCK)
        first_block, first = np.cumsum(blocks) - blocks, np.cumsum(sizes) - sizes
        within = np.arange(len(read)) - first[owner]
        lanes = np.zeros((BLOCK, int(blocks.sum())), np.int32)
        lanes[within % BLOCK, first_block[owner] + within // BLOCK] = read
        of = np.repeat(np.arange(n), blocks)
        out = np.zeros((n, len(self.languages)))
        pads, goes_on = (lanes == 0).sum(0), of[1:] == of[:-1]
        for k, (step, first_step) in enumerate(self.tables):
            ends = parsed(lanes, step, first_step, goes_on)
            out[:, k] = np.bincount(of, ends - pads, n) + (sizes > 0)  # no text holds what fills up blocks
        return out / np.maximum(sizes, 1)[:, None], np.bincount(owner, read > 1, n) > 0

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language of each text, and how far its phrases are below the runner-up's, as a share of those."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        cost, real = self.phrases(texts)
        best = cost.argmin(1)
        ranked = np.sort(cost, 1)
        score = 1 - ranked[:, 0] / np.maximum(ranked[:, 1], 1e-12) if ranked.shape[1] > 1 else np.ones(len(texts))
        return [self.languages[b] if r else UNKNOWN for b, r in zip(best.tolist(), real, strict=True)], np.where(real, score, 0.0)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """A model from a bounded sample of labelled rows. Null texts and languages teach nothing; without rows, nothing is learned.

    Copies of a text count once. A language with fewer than ROWS texts of the preferred lengths uses others as well.
    """
    order = F.xxhash64(F.lit("language"), "_text")
    rows = labelled.select(F.col(lang).alias("_lang"), F.col(text).alias("_text")).dropna().filter(F.length("_text") > 0)
    rows = rows.select("_lang", "_text", order.alias("_order"), F.length("_text").between(*LENGTHS).alias("_good"))
    counts = rows.select("_lang", "_order", "_good").distinct().groupBy("_lang").agg(F.count_if("_good").alias("_n"), F.count_if(~F.col("_good")).alias("_other"))
    size = CHARACTERS // 8
    start = F.pmod(F.xxhash64(F.lit("piece"), "_text"), F.greatest(F.length("_text") - size + 1, F.lit(1)))
    piece = F.substr("_text", (start + 1).cast("int"), F.lit(size))
    # of over 180 texts, about 180 pass by their hashes, of which the first ROWS are taken
    share = F.when(F.col("_good"), 3.0 * ROWS / F.col("_n")).when(F.col("_n") < ROWS, 3.0 * ROWS / F.col("_other")).otherwise(0.0)
    few = rows.join(F.broadcast(counts), "_lang").filter(F.pmod("_order", F.lit(1 << 30)) < share * (1 << 30)).select("_lang", piece.alias("_text"), "_order", "_good").distinct()
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy(F.desc("_good"), "_order"))
    texts: dict[str, str] = {}
    for r in few.select("_lang", "_text", rank.alias("_rank")).filter(F.col("_rank") <= ROWS).orderBy("_lang", "_rank").collect():
        have = texts.get(r[0], "")
        texts[r[0]] = have + (" " if have else "") + r[1][: max(0, CHARACTERS - len(have))]
    return Model(texts)


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every row, from its whole text; null texts and texts without a letter are `und`, score 0."""
    docs = docs.select(key, text)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        texts, names, scores = [x or "" for x in batch.column(1).to_pylist()], [], []
        for a, b in chunks(np.array([len(x) for x in texts])):
            name, score = sent.value.predict(texts[a:b])
            names += name
            scores.append(score)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(np.concatenate(scores))], names=[key, "lang_pred", "score"])

    return arrow_map(docs, run, f"`{key}` {docs.schema[key].dataType.simpleString()}, lang_pred string, score double")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(crc32_mod("doc_id", 5) != 0))
    out = identify(docs, model).withColumn("held_out", F.coalesce(crc32_mod("doc_id", 5) == 0, F.lit(False)))
    return out.select("doc_id", "held_out", "lang_pred", "score")
