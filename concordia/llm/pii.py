"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes."""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, table
from .secrets import digest, reaching

KINDS = ("email", "ip", "card", "phone", "contact", "identity")
LABELS = ("O", "B-contact", "I-contact", "B-identity", "I-identity")
#: Words of context on each side of a token that the field reads around.
CONTEXT = 2
#: The labelled table the field is trained on: tokens, with /c for a contact number or address and /i for an identity number.
LABELLED = """
call me on (212)/c 555-0147/c after six
her number is 415/c 555/c 2671/c and his is 415/c 555/c 9923/c
phone (030)/c 901820/c is the desk
tel 555-867-5309/c or fax 555-867-5310/c today
write to jane/c at/c example9/c dot/c org/c please
mail bob77/c (at)/c host/c dot/c com/c soon
mobile 0171-555-2368/c works
reach us: 0800/c 123/c 4567/c ext 12
ssn 078-05-1120/i was listed
social security 219-09-9999/i of the man
passport no C01X00T47/i expired
passport X4821957/i and visa
iban DE44500105175407324931/i paid
the id 123-45-6789/i belongs to her
tax number 12/345/67890/i on file
licensed under version 2.0. of the text
under CC BY-NC 4.0. only
chapter 12 page 345 of 1999
in 2021 there were 15 of 300
the year 1984 and 2001-09-11 were long
sum of 3.14159 and 2.71828 is known
room 101 at 10:30 on 12/05/2020 again
about 4040549990366437 in all
IT READ 4929718223101178! AND THEN
from 10.0.0.1 to 129.45.227.94 it went
version 1.2.3.4 build 20200101
a.user12@mail.example.org wrote this
+1 (275) 555-5927 the line
+44 20 7946 0958 rang
token = "7702344ead31d5951ffa625c69a7546f3a470a7f" here
key dafbac99949115180e7593de87b4492bcef9890b set
route 66 and area 51
10,000 men and 5,000 more
section 4(a) and part 2b
h2o and co2 at 25% of 80%
1 2 3 4 5 6 7
it scored 3-2 or 21-14 then
isbn 978-3-16-148410-0 was printed
write to jane/c at/c example/c dot/c org/c please
mail bob/c (at)/c host/c dot/c com/c soon
reach mary/c [at]/c mail/c [dot]/c net/c today
jane/c dot/c doe/c at/c post/c dot/c co/c dot/c uk/c is hers
tom/c (at)/c school/c (dot)/c edu/c
contact anna/c AT/c firm/c DOT/c de/c or call
sam/c at/c inbox/c dot/c com/c
kim/c dot/c lee/c at/c mailer/c dot/c net/c
and then rob/c at/c server/c dot/c org/c said
mail root@localhost/c now
ask jane@localhost/c or admin@mailhost/c first
bob@intranet/c wrote
look at the dot on the map
she was at home and at work
they met at noon at the old house
a dot is a point and the dot moved
the red dot at the end of the line
dot by dot and line by line
it was over. At noon he left
long gone. At or near the end
so it hath. At last they
at last he came at once
not at all said the man
he stood at example and sat at host
sold @ market and @ home
@jane said and @bob said
join the dot plot at the top
at school at mail at office
polka dot dress at a shop
"""


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Matches of the fixed patterns, by kind leftmost and not overlapping."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end(), "email"))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", max(free, at + 1))
    if _DIGIT.search(text):
        if "." in text:
            out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(_byte(x) for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile("[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # one that starts within a run of digits starts no match
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: What the field reads around: a digit, an at sign, and the words at and dot, which stand for signs in hidden addresses.
_MARK = re.compile(r"[0-9@]|(?<![^\s(\[{<])(?:at|dot|AT|DOT|At|Dot)(?![^\s)\]}>])")


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def shape(word: str) -> str:
    """Digits as 9, letters as a or A, runs over four as four; other marks stay."""
    out = re.sub("[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", word)))
    return re.sub(r"(.)\1{4,}", r"\1\1\1\1", out)


def core(text: str, a: int, b: int) -> tuple[int, int]:
    """Where text[a:b] stands without quotes before it, marks of sentences behind it, and brackets that don't belong to it.

    Brackets around the whole belong to it if it is short, as around an area code; one without its partner never does.
    """
    while b > a + 1:
        if text[b - 1] in ".,;:!?\"'":
            b -= 1
        elif text[a] in "\"'":
            a += 1
        elif text[b - 1] in ")]}>" and not any(x in text[a : b - 1] for x in "([{<"):
            b -= 1
        elif text[a] in "([{<" and not any(x in text[a + 1 : b] for x in ")]}>"):
            a += 1
        elif text[a] in "([{<" and text[b - 1] in ")]}>" and b - a > 8:
            a, b = a + 1, b - 1
        else:
            break
    return a, b


def features(tokens: list[str]) -> list[list[str]]:
    """For each token its shapes, fine and coarse, without the marks around it, and its neighbours'."""
    fine = [shape(t[slice(*core(t, 0, len(t)))]) for t in tokens]
    coarse = [re.sub(r"(.)\1+", r"\1", s) for s in fine]
    pad = ["^", "^", *coarse, "$", "$"]
    low = ["^", *[t.lower().strip(".,:;()") if t.isalpha() or len(t) < 12 and not _DIGIT.search(t) else "" for t in tokens], "$"]
    return [[f"f={fine[i]}", f"c={coarse[i]}", f"p={pad[i + 1]}", f"n={pad[i + 3]}", f"w={low[i + 1]}", f"pw={low[i]}", f"nw={low[i + 2]}", f"pc={pad[i + 1]}|{coarse[i]}", f"d={sum(c.isdigit() for c in tokens[i])}", "bias"] for i in range(len(tokens))]


class Field:
    """Weights of features by label and of transitions, trained by gradient ascent on the labelled table."""

    def __init__(self, labelled: str = LABELLED, rounds: int = 150, rate: float = 0.3, decay: float = 0.01):
        rows = [[(t[:-2], t[-1]) if t[-2:] in ("/c", "/i") else (t, "") for t in line.split()] for line in labelled.strip().splitlines()]
        names = {"": "", "c": "contact", "i": "identity"}
        data = []
        for row in rows:
            y = [LABELS.index("O" if not k else f"{'I' if j and row[j - 1][1] == k else 'B'}-{names[k]}") for j, (_, k) in enumerate(row)]
            data.append((features([t for t, _ in row]), y))
        self.index = {f: i for i, f in enumerate(dict.fromkeys(f for x, _ in data for some in x for f in some))}
        self.weights, self.steps = np.zeros((len(self.index) + 1, len(LABELS))), np.zeros((len(LABELS), len(LABELS)))
        self.weights_of(data, rounds, rate, decay)

    def weights_of(self, data, rounds, rate, decay):
        known = [(np.array([[self.index[f] for f in some] for some in x]), np.array(y)) for x, y in data]
        gw2, gs2 = np.full(self.weights.shape, 1e-8), np.full(self.steps.shape, 1e-8)
        for _ in range(rounds):
            gw, gs = -decay * self.weights, -decay * self.steps
            for x, y in known:
                e = self.weights[x].sum(1)
                n = len(y)
                alpha, beta = np.zeros_like(e), np.zeros_like(e)
                alpha[0] = e[0]
                for t in range(1, n):
                    alpha[t] = e[t] + np.logaddexp.reduce(alpha[t - 1][:, None] + self.steps, 0)
                for t in range(n - 2, -1, -1):
                    beta[t] = np.logaddexp.reduce(self.steps + (e[t + 1] + beta[t + 1])[None], 1)
                z = np.logaddexp.reduce(alpha[-1])
                d = -np.exp(alpha + beta - z)
                d[np.arange(n), y] += 1
                for col in range(x.shape[1]):
                    np.add.at(gw, x[:, col], d)
                for t in range(1, n):
                    gs -= np.exp(alpha[t - 1][:, None] + self.steps + (e[t] + beta[t])[None] - z)
                    gs[y[t - 1], y[t]] += 1
            gw2 += gw * gw
            gs2 += gs * gs
            self.weights += rate * gw / np.sqrt(gw2)
            self.steps += rate * gs / np.sqrt(gs2)
        self.weights[-1] = 0  # unknown features

    def decode(self, sequences: list[list[str]]) -> list[list[int]]:
        """The likeliest labels of each sequence: Viterbi over all sequences of a batch, step by step."""
        if not sequences:
            return []
        sizes = np.array([len(s) for s in sequences])
        order = np.argsort(-sizes, kind="stable")
        unknown, get = len(self.index), self.index.get
        flat = [[get(f, unknown) for f in some] for s in sequences for some in features(s)]
        scores = self.weights[np.array(flat)].sum(1)
        first = (np.cumsum(sizes) - sizes)[order]
        longest, k = int(sizes.max()), len(LABELS)
        live = np.searchsorted(-sizes[order], -np.arange(1, longest + 1), "right")
        best, back = scores[first], []
        final = np.zeros((len(sequences), k))
        for t in range(1, longest):
            m = live[t]
            final[m : live[t - 1]] = best[m : live[t - 1]]
            step = best[:m, :, None] + self.steps[None]
            back.append(step.argmax(1))
            best = step.max(1) + scores[first[:m] + t]
        final[: len(best)] = best
        state = final.argmax(1)
        paths = np.zeros((longest, len(sequences)), np.int64)
        for t in range(longest - 1, -1, -1):
            m = live[t]
            paths[t, :m] = state[:m]
            if t:
                state[:m] = back[t - 1][np.arange(m), state[:m]]
        out: list[list[int]] = [[]] * len(sequences)
        for row, i in enumerate(order.tolist()):
            out[i] = paths[: sizes[i], row].tolist()
        return out


@cache
def field() -> Field:
    return Field()


_WORD = re.compile(r"\S+")


def _before(text: str, at: int) -> list[tuple[int, int]]:
    """The last CONTEXT words that end before a place, whole."""
    out: list[tuple[int, int]] = []
    while len(out) < CONTEXT:
        while at and text[at - 1].isspace():
            at -= 1
        if not at:
            break
        end = at
        while at and not text[at - 1].isspace():
            at -= 1
        out.append((at, end))
    return out[::-1]


def sequences(text: str) -> list[list[tuple[int, int]]]:
    """Token sequences the field reads: each run of tokens with a digit, an at sign or the word at or dot, and the words
    of context around it. Other words are not read.
    """
    marked, end = [], 0
    for m in _MARK.finditer(text):
        if m.start() < end:
            continue
        a = m.start()
        while a > end and not text[a - 1].isspace():
            a -= 1
        b = m.end()
        while b < len(text) and not text[b].isspace():
            b += 1
        marked.append((a, b))
        end = b
    out: list[list[tuple[int, int]]] = []
    for i, (a, b) in enumerate(marked):
        after = marked[i + 1][0] if i + 1 < len(marked) else len(text)
        before = _before(text, a)
        behind = [m.span() for m in islice(_WORD.finditer(text, b, after), CONTEXT)]
        if out and before and before[0][0] < out[-1][-1][1]:
            out[-1] += [x for x in before if x[0] >= out[-1][-1][1]]
        elif out and out[-1][-1][1] == a or out and not before and len(out[-1]) and out[-1][-1][1] > a - 2:
            pass
        else:
            out.append(before)
        out[-1] += [(a, b), *behind]
    return out


def find_all(texts: list[str | None], model: Field) -> list[list[tuple[int, int, str]]]:
    """All spans of each text by start, then kind; spans of the field that overlap a fixed one are left out."""
    base = [base_spans(x) if x else [] for x in texts]
    fixed = [reaching(x) for x in base]
    own, read = [], []
    for i, x in enumerate(texts):
        for s in sequences(x) if x and _MARK.search(x) else []:
            own.append((i, s))
            read.append([x[a:b] for a, b in s])
    for (i, s), labels in zip(own, model.decode(read), strict=True):
        j = 0
        while j < len(s):
            label = LABELS[labels[j]]
            k = j + 1
            if label != "O":
                while k < len(s) and LABELS[labels[k]] == f"I-{label[2:]}":
                    k += 1
                a, b = s[j][0], s[k - 1][1]
                a, b = core(texts[i], a, b)
                starts, reach = fixed[i]
                n = bisect_left(starts, b)  # of those that start before b, does one reach over a?
                if not (n and reach[n - 1] > a):
                    base[i].append((a, b, label[2:]))
            j = k
    return [sorted(x, key=lambda s: (s[0], KINDS.index(s[2]))) for x in base]


def scan(frame: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans array<struct<kind,start,end>>) of every row, in code points, end exclusive.

    Null and empty texts have no spans; repeated rows give a row each; whole texts are scanned.
    """
    frame = frame.select(key, text)
    sent = frame.sparkSession.sparkContext.broadcast(field())  # trained here once: some thousand weights
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batch):
        spans = [[{"kind": k, "start": a, "end": b} for a, b, k in some] for some in find_all(batch.column(1).to_pylist(), sent.value)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=[key, "spans"])

    return arrow_map(frame, run, f"`{key}` {frame.schema[key].dataType.simpleString()}, spans array<struct<kind:string,start:int,end:int>>")


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, end = [], 0
    for a, b, kind in spans:
        if b > end:
            out += [text[end : max(a, end)], f"[{kind.upper()}]" if a >= end else ""]
            end = b
    return "".join(out) + text[end:]


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span of personal data replaced by its kind in brackets, n_chars to match; null texts stay null."""
    columns, kind = docs.columns, docs.schema
    at = columns.index(text)
    sent = docs.sparkSession.sparkContext.broadcast(field())

    def run(batch):
        texts = batch.column(at).to_pylist()
        new = [x and masked(x, s) for x, s in zip(texts, find_all(texts, sent.value), strict=True)]
        arrays = [pa.array(new, batch.schema.field(at).type) if i == at else batch.column(i) for i in range(len(columns))]
        return pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    out = arrow_map(docs, run, kind)
    return out.withColumn("n_chars", F.length(text).cast(kind["n_chars"].dataType)) if "n_chars" in columns else out


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and digest of the fixed patterns, and all spans."""
    return digest(scan(table(spark, sf_dir, "documents")), KINDS, KINDS[:4])
