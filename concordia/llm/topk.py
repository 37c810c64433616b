"""Exact top-k search by inner product over a pivot-distance index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, keep, table

#: Pivots (a sample by hash), at least, at most, and one for so many vectors; and vectors of a block of an annulus or of queries.
PIVOTS, BLOCK = (32, 1024, 4096), 1024
#: Slack of distances, relative, for rounding: bounds are only used beyond it.
SLACK = 1e-6


def integers(frame: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, v array<bigint>): floor(256 * x) of each component; rows with null keys or vectors, or with null or non-finite components, go."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    real = frame.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).dropna().filter(finite)
    return real.select("id", F.transform("v", lambda x: F.floor(x * 256)).alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix; shorter ones are filled up with noughts, which leaves inner products as they are."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of a and b: in floating point while every sum is below 2**53."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def lifted(v: np.ndarray, longest: float) -> np.ndarray:
    """One more component, so that all have the same norm: the nearest are then those of the highest inner product."""
    v = v.astype(np.float64)
    return np.hstack([v, np.sqrt(np.maximum(longest - (v * v).sum(1), 0))[:, None]])


def best(ids: np.ndarray, vectors: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query rows, ids, scores) of the k best for each query, its own id and repeats of an id and score left out; ties to smaller ids.

    Of scores under a query's floor none counts. Without floors the k-th of a query's scores is one, unless ids repeat.
    """
    scores = products(queries, vectors)
    other = ids[None] != own[:, None]
    if floor is None and len(ids) > k and len(np.unique(ids)) == len(ids):
        floor = np.partition(np.where(other, scores, np.iinfo(np.int64).min), len(ids) - k, axis=1)[:, len(ids) - k]
    q, i = np.nonzero(other if floor is None else other & (scores >= floor[:, None]))
    s, found = scores[q, i], ids[i]
    order = np.lexsort((found, -s, q))
    q, s, found = q[order], s[order], found[order]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (s[1:] != s[:-1]) | (found[1:] != found[:-1])
    q, s, found = q[new], s[new], found[new]
    use = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[use], found[use], s[use]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, key, score): for each query its k highest inner products of floor(256 * x) with rows of other keys.

    Ties go to the smaller key; a query with fewer candidates gets all. Vectors that are null or hold null or
    non-finite components take no part; of vectors of different length the shorter counts as filled up with noughts.
    Rows that repeat a key and vector count once, a query asked twice is answered once.

    Each vector is keyed by its nearest pivot and its distance from it; runs of this order form blocks of bounded size
    (annuli). A query meets the blocks around its own distance first, which bounds its k-th distance; then it meets
    every block whose annulus the triangle inequality can't rule out. Queries, too, come in blocks, so the work is
    dealt out in pairs of blocks whatever the number of copies of a vector.
    """
    spark = vectors.sparkSession
    rows = keep(integers(vectors, key, vector).distinct())
    asked = keep(integers(queries, key, vector).distinct())
    stats = rows.agg(F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)), F.count("*")).first()
    asked_stats = asked.agg(F.max(F.size("v")), F.count("*")).first()
    schema = "query_id bigint, rank int, `%s` bigint, score bigint" % key
    if stats[0] is None or asked_stats[0] is None:
        return spark.createDataFrame([], schema)
    width, longest = max(stats[0], asked_stats[0], 1), float(stats[1])
    many = min(max(stats[2] // PIVOTS[2], PIVOTS[0]), PIVOTS[1])
    sample = [r[0] for r in rows.orderBy(F.xxhash64("id"), "id").limit(many).select("v").collect()]
    pivots = lifted(matrix(pa.array(sample, pa.list_(pa.int64())), width), longest)

    def distances(v: np.ndarray, query: bool) -> np.ndarray:
        points = np.hstack([v.astype(np.float64), np.zeros((len(v), 1))]) if query else lifted(v, longest)
        square = (points * points).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * points @ pivots.T
        return np.sqrt(np.maximum(square, 0))

    def place(query: bool):
        def run(batch):
            d = distances(matrix(batch.column(1), width), query)
            near = d.argmin(1)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])], names=["id", "v", "pivot", "distance"])

        return run

    def pack(query: bool):
        """Runs of a sorted partition as blocks of up to BLOCK vectors of one pivot."""

        def run(batches):
            held: list[pa.RecordBatch] = []

            def emit(t: pa.Table):
                for a in range(0, len(t), BLOCK):
                    part = t.slice(a, BLOCK).combine_chunks()
                    v = matrix(part.column("v").combine_chunks(), width)
                    d = part.column("distance").to_numpy()
                    own = distances(v, query)
                    lo, hi = (own.min(0), own.max(0)) if query else (d.min(), d.max())
                    # a bound for many queries at once is as wide as they are apart, so they keep their own distances too
                    extra = [pa.array([lo.tolist()]), pa.array([hi.tolist()])] if query else [pa.array([float(lo)]), pa.array([float(hi)])]
                    yield pa.RecordBatch.from_arrays([pa.array([part.column("pivot")[0].as_py()], pa.int32()), *extra, pa.array([part.column("id").to_numpy().astype(np.int64).tobytes()]), pa.array([v.tobytes()])], names=["pivot", "low", "high", "ids", "data"])

            def flush(final: bool):
                nonlocal held
                t = pa.Table.from_batches(held)
                pivot = t.column("pivot").to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(pivot)) + 1).tolist(), len(pivot)]
                held = []
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    whole = b - a if final or b < len(pivot) else (b - a) // BLOCK * BLOCK
                    if whole:
                        yield from emit(t.slice(a, whole))
                    if whole < b - a:
                        held = t.slice(a + whole).to_batches()

            for batch in batches:
                if batch.num_rows:
                    held.append(batch)
                    if sum(x.num_rows for x in held) >= 2 * BLOCK:
                        yield from flush(False)
            if held:
                yield from flush(True)

        return run

    placed = arrow_map(rows, place(False), "id bigint, v array<bigint>, pivot int, distance double").repartitionByRange("pivot", "distance", "id").sortWithinPartitions("pivot", "distance")
    blocks = keep(placed.mapInArrow(pack(False), "pivot int, low double, high double, ids binary, data binary").withColumn("block", F.monotonically_increasing_id()))
    parts = int(min(200, max(1, asked_stats[1] // BLOCK + 1)))
    placed = arrow_map(asked, place(True), "id bigint, v array<bigint>, pivot int, distance double").repartitionByRange(parts, "pivot", "distance", "id").sortWithinPartitions("pivot", "distance")
    near = keep(placed.mapInArrow(pack(True), "pivot int, low array<double>, high array<double>, ids binary, data binary").withColumn("group", F.monotonically_increasing_id()))

    def meet(pairs: DataFrame, bounded: bool) -> DataFrame:
        """(query, id, score): the k best of each pair of a block of queries and a block of vectors."""

        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    get = lambda name, i=i, batch=batch: batch.column(name)[i].as_py()
                    own, ids = np.frombuffer(get("q_ids"), np.int64), np.frombuffer(get("ids"), np.int64)
                    q, v = np.frombuffer(get("q_data"), np.int64).reshape(len(own), width), np.frombuffer(get("data"), np.int64).reshape(len(ids), width)
                    floor = None
                    if bounded:
                        d = distances(q, True)[:, get("pivot")]
                        floor = np.array(get("floors"), np.float64)  # the k-th score so far
                        gap = np.maximum(np.maximum(d - get("high"), get("low") - d), 0)
                        square = (q.astype(np.float64) ** 2).sum(1) + longest
                        use = np.flatnonzero(gap * gap * (1 - SLACK) - SLACK * (1 + square) <= square - 2 * floor)
                        q, own, floor = q[use], own[use], floor[use]
                    row, found, score = best(ids, v, q, own, k, floor)
                    if len(row):
                        yield pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(found), pa.array(score)], names=["query", "id", "score"])

        return pairs.mapInArrow(run, "query bigint, id bigint, score bigint")

    def merged(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        return found.distinct().withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)

    ask = near.select("group", F.col("pivot").alias("q_pivot"), F.col("low").alias("q_low"), F.col("high").alias("q_high"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    # first, for each block of queries: the annulus nearest to it of each pivot
    at = F.explode(F.sequence(F.lit(0), F.lit(len(pivots) - 1)))
    wanted = ask.select("group", "q_low", "q_high", at.alias("pivot"))
    wanted = wanted.select("group", "pivot", F.expr("element_at(q_low, pivot + 1)").alias("a"), F.expr("element_at(q_high, pivot + 1)").alias("b"))
    rings = blocks.select("block", "pivot", "low", "high")
    reach = wanted.join(rings, "pivot").withColumn("gap", F.greatest(F.col("a") - F.col("high"), F.col("low") - F.col("b"), F.lit(0.0)))
    first = reach.groupBy("group").agg(F.min(F.struct("gap", F.abs(F.col("a") + F.col("b") - F.col("low") - F.col("high")).alias("off"), "block")).alias("m")).select("group", F.col("m.block").alias("block"))
    start = keep(merged(meet(first.join(blocks, "block").join(ask, "group"), False)))
    floors = start.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    # then every ring that the bound of the block's queries doesn't rule out, but for the first
    members = _members(ask)
    levels = members.join(floors, "query", "left").groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce(F.col("floor").cast("double"), F.lit(-1e300)).alias("f")))), lambda s: s["f"]).alias("floors"), F.min(F.coalesce(F.col("floor").cast("double"), F.lit(-1e300))).alias("least"), F.max("square").alias("square"))
    open_ = reach.join(levels.select("group", "least", "square"), "group").filter((F.col("gap") * F.col("gap") * (1 - SLACK) - SLACK * (1 + F.col("square") + longest)) <= F.col("square") + longest - 2 * F.col("least")).select("group", "block")
    open_ = open_.join(first, ["group", "block"], "left_anti")
    rest = meet(open_.join(blocks, "block").join(ask.join(levels, "group"), "group").repartition("group", "block"), True)
    out = merged(start.select("query", "id", "score").unionByName(rest))
    return out.select(F.col("query").alias("query_id"), "rank", F.col("id").alias(key), "score")


def _members(ask: DataFrame) -> DataFrame:
    """(group, pos, query, square) of each query of a block, square its squared norm."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column("q_ids")[i].as_py(), np.int64)
                v = np.frombuffer(batch.column("q_data")[i].as_py(), np.int64).reshape(len(ids), -1).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("group")[i].as_py()] * len(ids)), pa.array(np.arange(len(ids))), pa.array(ids), pa.array((v * v).sum(1))], names=["group", "pos", "query", "square"])

    return ask.select("group", "q_ids", "q_data").mapInArrow(run, "group bigint, pos bigint, query bigint, square double")


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


ORACLE = """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS e FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([p[1] * p[2] for p in list_zip(q.e, c.e)]) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
