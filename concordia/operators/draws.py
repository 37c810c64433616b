"""People drawn with replacement, all replicates at once: draws are dealt to leaves of people, and weigh their rows where these lie."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ranges of the people's hash, of which leaves are made; people of a leaf; weights (replicates by people) that a task holds
#: at most; and draws that are dealt to leaves at a time.
BITS, LEAF, HELD, DEALT = 12, 1 << 16, 4_000_000, 1 << 20
#: The constants of the public splitmix64 generator, fixed values.
STEP, FIRST, SECOND = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(h: np.ndarray) -> np.ndarray:
    """splitmix64's output function."""
    h = (h ^ (h >> np.uint64(30))) * FIRST
    h = (h ^ (h >> np.uint64(27))) * SECOND
    return h ^ (h >> np.uint64(31))


def hashed(seed: int, person: Column) -> Column:
    """A whole number below 2**32 from the md5 of seed and person."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), person.cast("string"))), 1, 8), 16, 10).cast("bigint")


def places(people: int, first: int, many: int, replicate: int, stream: int, seed: int) -> np.ndarray:
    """On which of so many people the draws first, first + 1, ... of a replicate fall, from 0; the stream is the group's number."""
    state = mixed(mixed(np.array([(seed << 32) + replicate], np.uint64)) + np.uint64(stream))
    return (mixed(state + STEP * np.arange(first, first + many, dtype=np.uint64)) % np.uint64(people)).astype(np.int64)


def weights(people: int, many: np.ndarray, stream: int, seed: int) -> np.ndarray:
    """(replicate, person): how often each of so many people of a group is drawn, if many[replicate] are drawn."""
    out = np.zeros((len(many), people), np.int32)
    for b, n in enumerate(many.tolist()):
        out[b] = np.bincount(places(people, 1, n, b, stream, seed), minlength=people)
    return out


def dealt(spark: SparkSession, groups: list[np.ndarray], replicates: int, seed: int) -> tuple[DataFrame, np.dtype]:
    """(_leaf, _replicate, _at) of all draws: on whom in the leaf they fall, as bytes of numbers of the type given beside.

    groups has the people of each leaf of each group. A replicate's draws are worked out DEALT at a time, in as many tasks
    as they take, and sent to the leaves, some two bytes a draw.
    """
    kind, deal = np.min_scalar_type(max(int(g.max()) for g in groups) - 1), DEALT
    people = [int(g.sum()) for g in groups]
    pieces = [-(-n // deal) for n in people]
    ends = np.cumsum(np.array(pieces) * replicates)
    leaves = np.cumsum([0, *map(len, groups)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in batch["id"].tolist():
                k = int(np.searchsorted(ends, at, "right"))
                b, piece = divmod(at - int(ends[k]) + pieces[k] * replicates, pieces[k])
                place = np.sort(places(people[k], 1 + piece * deal, min(deal, people[k] - piece * deal), b, k, seed))
                first = np.cumsum(groups[k]) - groups[k]
                cut = np.append(np.searchsorted(place, first), len(place))
                own = [(int(leaves[k]) + i, b, (place[x:y] - first[i]).astype(kind).tobytes()) for i, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if y > x]
                yield pd.DataFrame(own, columns=["_leaf", "_replicate", "_at"])

    jobs = int(ends[-1])
    tasks = min(jobs, max(spark.sparkContext.defaultParallelism, sum(people) * replicates // (4 * deal)))
    return spark.range(0, jobs, 1, tasks).mapInPandas(run, "_leaf int, _replicate int, _at binary"), kind


def resampled(frame: DataFrame, person: str, replicates: int, seed: int, function: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str, *by: str) -> DataFrame:
    """function(rows, weights) of each leaf of frame, which has one row a person; weights are replicates by rows.

    In every replicate each group of `by` is drawn from as often as it has people, each time one of them, all alike: a
    draw is a hash of seed, replicate, group and the draw's number, modulo the group's people in the order of their hash.
    So leaves, which are runs of that order of up to LEAF people each, or single ranges of the hash, change nothing about
    who is drawn. A group of one leaf is drawn from in the task that holds it; draws of others are dealt to their leaves.
    A row a replicate and person exists nowhere but in the task that holds the person. Groups are few. Null persons
    and groups go.
    """
    spark = frame.sparkSession
    h = hashed(seed, F.col(person))
    rows = frame.dropna(subset=[person, *by]).withColumn("_h", h).withColumn("_range", F.shiftright("_h", 32 - BITS))
    sizes = rows.groupBy(*by, "_range").agg(F.count("*").alias("_n")).orderBy(*by, "_range").collect()  # 2**BITS rows a group at most
    most, leaf, table, held = max(1, min(LEAF, HELD // max(1, replicates))), -1, [], {}
    for r in sizes:
        own = held.setdefault(tuple(r[c] for c in by), [])
        if not own or own[-1] + r._n > most:
            leaf += 1
            own.append(0)
        own[-1] += r._n
        table.append((*(r[c] for c in by), r._range, leaf))
    if not table or replicates < 1:
        return spark.createDataFrame([], schema)
    groups = [np.array(own) for own in held.values()]
    kinds = "".join(f"`{c}` {frame.schema[c].dataType.simpleString()}, " for c in by)
    leaves = F.broadcast(spark.createDataFrame(table, f"{kinds}_range long, _leaf int"))
    own = rows.join(leaves, [*by, "_range"]).groupBy("_leaf")
    if all(len(g) == 1 for g in groups):

        def alone(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(["_h", person]).reset_index(drop=True)
            return function(part, weights(len(part), np.full(replicates, len(part)), int(part["_leaf"][0]), seed))

        return own.applyInPandas(alone, schema)
    draws, kind = dealt(spark, groups, replicates, seed)

    def run(part: pd.DataFrame, drawn: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["_h", person]).reset_index(drop=True)
        weight = np.zeros((replicates, len(part)), np.int32)
        for b, at in zip(drawn["_replicate"], drawn["_at"], strict=True):
            weight[int(b)] += np.bincount(np.frombuffer(at, kind), minlength=len(part)).astype(np.int32)
        return function(part, weight)

    return own.cogroup(draws.groupBy("_leaf")).applyInPandas(run, schema)
