"""MinHash near-dedup: bottom-k sketches of one hash function, inverted lists, union-sketch estimates, exact Jaccard."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, arrow_map, chunks, drop, fresh, keep, mix, ragged, span_hashes, table, utf8, words

#: Values of a sketch, and how many two sketches share at least if 80 of 100 shingles are shared (but for a chance under 1e-8).
SKETCH, SHARED = 48, 20
#: Words of 64 bits in a set's parity bitmap.
BITMAP = 8
#: Rounds in which each list is held against one of its members, before what is left is compared in pairs.
ROUNDS = 2
_SALT = np.uint64(0xA24BAED4963EE407)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: words with A-Z lowered; a shorter text is one shingle, no words are none."""
    low = LOWER[data]
    starts, ends, at = words(low, offsets)
    own = span_hashes(low, starts, ends)
    n = np.diff(at)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    first = ragged(at[:-1], count)
    length = np.repeat(np.minimum(n, size), count)
    hashes = span_hashes(own, first, first + length)
    cuts = np.append(0, np.cumsum(count))
    return [np.unique(hashes[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """(_id, n, f1, f2, sketch): size of each text's set, a fingerprint of the set, and its smallest values."""

    def run(batch):
        data, offsets = utf8(batch.column(1))
        n, f1, f2, sketch = [], [], [], []
        for a, b in chunks(np.diff(offsets)):
            for s in shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size):
                n.append(len(s))
                f1.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)))
                f2.append(int(mix(s ^ _SALT).sum(dtype=np.uint64).view(np.int64)))
                sketch.append(s[:SKETCH].view(np.int64).tolist())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sketch, pa.list_(pa.int64()))], names=["_id", "n", "f1", "f2", "sketch"])

    return arrow_map(docs, run, f"_id {docs.schema['_id'].dataType.simpleString()}, n bigint, f1 bigint, f2 bigint, sketch array<bigint>")


def inverted(classes: DataFrame, similarity: int) -> DataFrame:
    """(a, n, value): classes by the sketch values in which a similar class must meet them.

    Sketches of similar sets share so many values, and small sets, which are sketched whole, share `similarity` of 100
    of theirs, that one of the rarest values will do: as many of the most frequent as that, less one, are left out.
    Values of one class alone meet nobody; so what shares a passage or a line, but not most of its text, has no lists.
    """
    each = classes.select("a", "n", F.explode("sketch").alias("value"))
    many = each.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    met = each.join(many, "value").groupBy("a").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "value"))).alias("values"))
    whole = F.ceil(F.col("n") * similarity / 100).cast("int") - 1
    spare = F.when(F.col("n") <= SKETCH * similarity // 100, whole).otherwise(F.lit(SHARED - 1))
    used = met.filter(F.size("values") > spare).select("a", "n", F.explode(F.slice("values", F.lit(1), F.size("values") - spare)).alias("v"))
    return used.select("a", "n", F.col("v.value").alias("value"))


def neighbours(classes: DataFrame) -> DataFrame:
    """(a, first, second, before): each value of a class's sketch with the next one, and the value before both.

    Of the smallest values of the union of two sets with 80 of 100 shared, each is shared with that chance; so of 48
    some two in a row are, but for a chance of 1e-13, and two shared in a row are in a row in both sketches. Of the places
    where two sketches agree in a row, that where `before` differs is the first: one place stands for the whole run.
    """
    at = F.sequence(F.lit(1), F.size("sketch") - 1)
    pair = F.transform(at, lambda i: F.struct(F.get("sketch", i - 1).alias("first"), F.get("sketch", i).alias("second"), F.when(i > 1, F.get("sketch", i - 2)).alias("before")))
    return classes.filter(F.size("sketch") > 1).select("a", F.explode(pair).alias("p")).select("a", "p.first", "p.second", "p.before")


def _sizes(n: str, m: str, similarity: int):
    """Whether sets of sizes n and m can be that similar."""
    return (100 * F.col(n) >= similarity * F.col(m)) & (100 * F.col(m) >= similarity * F.col(n))


def parity(s: np.ndarray) -> np.ndarray:
    """A bitmap in which each value of a set flips the bit that it falls on: two sets differ by as many values as bits, or more."""
    flips = np.bincount((mix(s ^ _SALT) % np.uint64(64 * BITMAP)).astype(np.int64), minlength=64 * BITMAP) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64)


def _differ_little(similarity: int):
    """Whether sets x and y can be that similar by their bitmaps: 20 of 180 of both sizes may differ, at most."""
    bits = sum((F.bit_count(F.col(f"x.b{k}").bitwiseXOR(F.col(f"y.b{k}"))) for k in range(BITMAP)), F.lit(0))
    return (100 + similarity) * bits <= (100 - similarity) * (F.col("x.n") + F.col("y.n"))


def verified(pairs: DataFrame, classes: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) whose sets share `similarity` of 100 at least, first by the sketches' union, then exactly.

    Of the union's smallest values as many must be shared as similar sets share (but for that chance under 1e-8).
    """
    left = classes.select("a", F.col("sketch").alias("sa"), F.col("n").alias("na"))
    right = classes.select(F.col("a").alias("b"), F.col("sketch").alias("sb"), F.col("n").alias("nb"))
    both = pairs.join(left, "a").join(right, "b").filter(_sizes("na", "nb", similarity))
    low = F.slice(F.array_sort(F.transform(F.array_union("sa", "sb"), lambda x: x.bitwiseXOR(F.lit(-(1 << 63))))), 1, SKETCH)  # in unsigned order, as sketches are
    shared = F.size(F.array_intersect(low, F.transform(F.array_intersect("sa", "sb"), lambda x: x.bitwiseXOR(F.lit(-(1 << 63))))))
    near = both.filter(shared * SKETCH >= SHARED * F.size(low)).select("a", "b")
    both = near.join(sets.select("a", F.col("set").alias("x")), "a").join(sets.select(F.col("a").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")

    def run(batch):
        good = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            good.append(100 * common >= similarity * (len(x) + len(y) - common))
        return batch.select(["a", "b"]).filter(pa.array(good))

    kind = pairs.schema["a"].dataType.simpleString()
    return arrow_map(both, run, f"a {kind}, b {kind}")


def components(links: DataFrame) -> DataFrame:
    """(a, comp): the smallest member of each member's component, by alternating large and small stars over the links (a, b)."""
    edges = keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        last, edges = edges, keep(small)
        drop(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            out = edges.select(F.col("u").alias("a"), F.col("v").alias("comp"))
            out.__dict__["_kept_at"] = edges.__dict__["_kept_at"]
            return out
        state = now


def near_duplicates(frame: DataFrame, size: int = 4, similarity: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept): the smallest key reachable over links between similar texts, by row.

    Two texts are linked if their sets of `size`-word shingles share `similarity` of 100 at least. Null and empty texts
    are linked with nothing, not even each other. Rows with a null key are linked with nothing and not kept; rows that
    repeat a key are one member of their group.

    Texts of one set form a class, so copies never meet in pairs. Classes that share a sketch value stand in its list.
    In each round a list's first member not yet held against it meets the members of other components, so a list of
    thousands of near copies costs as many pairs, not their square. Members of lists that still span components meet in
    pairs where two values in a row of their sketches agree, each pair once for each run that agrees, not for each value.
    Pairs that sizes or parity bitmaps prove to be too different are left out; both bounds are exact. A link of exactly
    `similarity` is missed with a chance under 1e-8, as sketches are samples; sets of up to 48 shingles are sketched whole.
    """
    docs = frame.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    base = keep(sketches(docs, size))
    known = base.filter("n > 0 AND _id IS NOT NULL")
    classes = keep(known.groupBy("f1", "f2", "n").agg(F.min("_id").alias("a"), F.first("sketch").alias("sketch")))
    lists = keep(inverted(classes, similarity))
    some = keep(lists.select("a").distinct())
    few = some.limit(400_001).count() <= 400_000
    again = docs.join(F.broadcast(some) if few else some, docs["_id"] == some["a"], "left_semi")
    bitmap = [f"b{k}" for k in range(BITMAP)]

    def whole(batch):
        data, offsets = utf8(batch.column(1))
        sets = [s for a, b in chunks(np.diff(offsets)) for s in shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)]
        maps = np.array([parity(s) for s in sets])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary()), *map(pa.array, maps.T)], names=["a", "set", *bitmap])

    kind = frame.schema[key].dataType.simpleString()
    sets = keep(arrow_map(again, whole, f"a {kind}, set binary, {', '.join(f'{b} bigint' for b in bitmap)}"))
    links, comps, hubs = None, keep(some.select("a", F.col("a").alias("comp"))), None

    def active() -> DataFrame:
        """Members of the lists that hold several components."""
        members = lists.join(comps, "a")
        mixed = members.groupBy("value").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("value")
        return members.join(mixed, "value")

    for _ in range(ROUNDS):
        members = keep(active())
        rest = members if hubs is None else members.join(hubs.select("value", F.col("hub").alias("last")), "value").filter("a > last")
        chosen = keep(rest.groupBy("value").agg(F.min(F.struct("a", "comp", "n")).alias("h")).select("value", F.col("h.a").alias("hub"), F.col("h.comp").alias("hub_comp"), F.col("h.n").alias("hub_n")))
        pairs = members.join(chosen, "value").filter("a > hub AND comp <> hub_comp").filter(_sizes("n", "hub_n", similarity)).select(F.col("hub").alias("a"), F.col("a").alias("b")).distinct()
        links, comps, more = _linked(verified(pairs, classes, sets, similarity), links, comps)
        drop(members, hubs)
        hubs = chosen
        if not more:
            break
    open_ = keep(active().select("a").distinct())
    left = classes.join(open_, "a").join(comps, "a").join(sets.select("a", *bitmap), "a")
    runs = neighbours(left).join(left.select("a", "n", "comp", *bitmap), "a")
    mixed = neighbours(left).join(comps, "a").groupBy("first", "second").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("first", "second")
    runs = keep(runs.join(mixed, ["first", "second"]))
    start = F.col("x.before").isNull() | F.col("y.before").isNull() | (F.col("x.before") != F.col("y.before"))
    met = runs.alias("x").join(runs.alias("y"), ["first", "second"]).filter("x.a < y.a AND x.comp <> y.comp").filter(start & _sizes("x.n", "y.n", similarity) & _differ_little(similarity))
    pairs = met.select(F.col("x.a").alias("a"), F.col("y.a").alias("b")).distinct()
    links, comps, _ = _linked(verified(pairs, classes, sets, similarity), links, comps)
    drop(lists, some, hubs, sets, open_, runs, links)
    named = base.join(classes.select("f1", "f2", "n", "a"), ["f1", "f2", "n"], "left").join(comps, "a", "left")
    alone = F.col("n") == 0
    component = F.when(F.col("_id").isNull(), F.lit(None)).when(alone, F.col("_id")).otherwise(F.coalesce("comp", "a"))
    out = named.select(F.col("_id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))


def _linked(found: DataFrame, links: DataFrame | None, comps: DataFrame):
    """All links so far, the components they make, and whether any were found."""
    found = keep(found)
    if found.isEmpty():
        drop(found)
        return links, comps, False
    both = found if links is None else keep(links.unionByName(found))
    if both is not found:
        drop(links, found)
    made = components(both)
    now = keep(comps.select("a").join(made, "a", "left").select("a", F.coalesce("comp", "a").alias("comp")))
    drop(made, comps)
    return both, now, True


def one_of_each(docs: DataFrame, size: int = 5, similarity: int = 80) -> DataFrame:
    """docs with one row of each group of near duplicates, that of the smallest doc_id; rows with a null doc_id stay.

    Of rows that repeat the kept doc_id one stays.
    """
    found = near_duplicates(docs, size, similarity)
    own, other = fresh(docs, "_gone"), fresh(docs, "_twice")
    gone = keep(found.filter(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias(own)).distinct())
    few = gone.limit(400_001).count() <= 400_000
    left = docs.join(F.broadcast(gone) if few else gone, F.col("doc_id") == F.col(own), "left_anti")
    twice = keep(found.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias(other)))
    if twice.isEmpty():
        return left
    many = left.join(twice, F.col("doc_id") == F.col(other), "left_semi")
    return left.join(twice, F.col("doc_id") == F.col(other), "left_anti").unionByName(many.dropDuplicates(["doc_id"]))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
