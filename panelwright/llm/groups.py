"""Groups of records from pairwise matches, by low-diameter decomposition."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.session import Scratch

#: Clusters of the first level have a radius of about ln(n)/BETA; about a share BETA of the links runs between them.
BETA = 0.2
#: A step is small where fewer than a share SMALL of the vertices have changed; it then goes HOPS links on at once.
SMALL, HOPS = 0.05, 4
#: So many links between clusters, or fewer, are decomposed further in one task.
TAIL = 20_000


def _priority(v, level: int, seed: int):
    """An exponential shift for each vertex, the same whenever it is computed."""
    u = (F.pmod(F.xxhash64(v, F.lit(level), F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u)


def _grow(links: DataFrame, level: int, beta: float, seed: int, scratch: Scratch) -> DataFrame:
    """(v, c): the cluster c of each vertex v. Cluster u starts at the time minus its shift and takes one link per unit of time.

    Only vertices whose cluster changed tell their neighbours; a step reads what is known of those, and writes
    only what changes for them. What is known is a base and the changes since; they are merged when they have grown.
    """
    start = links.select(F.col("a").alias("v")).distinct().select("v", F.struct((-_priority(F.col("v"), level, seed) / beta).alias("at"), F.col("v").alias("c")).alias("best"))
    base, seen = scratch.write(start)
    n, grown = seen["rows"], 0
    known, front, moved = [base], base, n
    together = lambda: functools.reduce(DataFrame.unionByName, known)

    while moved:
        small = moved < SMALL * n
        reached, edge = None, front
        for _ in range(HOPS if small else 1):
            on = edge.join(links, F.col("v") == F.col("a")).select(F.col("b").alias("v"), F.struct((F.col("best.at") + 1).alias("at"), F.col("best.c").alias("c")).alias("best"))
            edge = on.groupBy("v").agg(F.min("best").alias("best"))
            reached = edge if reached is None else reached.unionByName(edge)
        if small:
            # written, so that the planner knows that it is small and reads the base where it lies
            reached, _ = scratch.write(reached.groupBy("v").agg(F.min("best").alias("best")))
        was = together().select(F.col("v").alias("kv"), F.col("best.at").alias("was"))
        change = reached.join(was, F.col("v") == F.col("kv")).groupBy("v").agg(F.min("best").alias("best"), F.min("was").alias("was"))
        front, seen = scratch.write(change.where(F.col("best.at") < F.col("was")).select("v", "best"))
        if small:
            scratch.drop(reached)
        moved = seen["rows"]
        known.append(front)
        grown += moved
        if grown > n / 2 and moved:
            merged, _ = scratch.write(together().groupBy("v").agg(F.min("best").alias("best")))
            scratch.drop(*known[:-1])
            known, grown = [merged], 0
    held, _ = scratch.write(together().groupBy("v").agg(F.min("best").alias("best")).select("v", F.col("best.c").alias("c")))
    scratch.drop(*known)
    return held


def _decompose(a: np.ndarray, b: np.ndarray, n: int, beta: float, seed: int) -> np.ndarray:
    """The group of each of n vertices under links a, b (both ways), by the same decomposition."""
    rng, of = np.random.default_rng(seed), np.arange(n)
    while len(a):
        at, owner = -rng.exponential(1 / beta, n), np.arange(n)
        front = np.ones(n, bool)
        while front.any():
            use = front[a]
            x, y = a[use], b[use]
            time = at[x] + 1
            order = np.lexsort((time, y))
            y, x, time = y[order], x[order], time[order]
            first = np.r_[True, y[1:] != y[:-1]] if len(y) else np.zeros(0, bool)
            y, x, time = y[first], x[first], time[first]
            sooner = time < at[y]
            front = np.zeros(n, bool)
            front[y[sooner]] = True
            took = owner[x[sooner]]
            at[y[sooner]], owner[y[sooner]] = time[sooner], took
        of = owner[of]
        a, b = owner[a], owner[b]
        cell = np.unique(a[a != b] * n + b[a != b])
        a, b = cell // n, cell % n
    return of


def _finish(links: DataFrame, beta: float, seed: int) -> DataFrame:
    """(v, c) of the last few links: all that follows of the recursion, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches), pa.schema([("a", pa.string()), ("b", pa.string())]))
        if not len(t):
            return
        both = pa.chunked_array([*t.column("a").chunks, *t.column("b").chunks]).combine_chunks().dictionary_encode()
        code, names = both.indices.to_numpy().astype(np.int64), both.dictionary
        of = _decompose(code[: len(t)], code[len(t) :], len(names), beta, seed)
        yield pa.RecordBatch.from_arrays([names, names.take(pa.array(of))], names=["v", "c"])

    return links.select("a", "b").repartition(1).mapInArrow(run, "v string, c string")  # at most TAIL rows


def link_groups(pairs: DataFrame, left: str, right: str, *, beta: float = BETA, seed: int = 7) -> DataFrame:
    """One group for all records that are linked directly or over others.

    pairs: one row per link; left and right name its two id columns. Returns record_id and group_id,
    the smallest id of the group, one row per id that is linked to another one.

    Clusters grow from start times shifted by exponential random numbers, each vertex going to the
    cluster that reaches it first; the clusters become the vertices of a smaller graph that has the
    links between clusters, and so on until no link is left; the assignments of all levels are then
    composed. A level ends after O(log n / beta) steps even for long chains, and keeps about a share
    beta of the links; a step's work follows the vertices that changed in the one before. The last TAIL
    links between clusters are decomposed by the same method in one task. Nothing but counts reaches the driver.

    Links with a null id, and links of an id with itself, give no rows; repeated and turned links count
    once; no links, no rows; other columns are ignored, whatever their names.
    """
    spark = pairs.sparkSession
    scratch = Scratch(spark, "groups")
    x, y = pairs[left].cast("string"), pairs[right].cast("string")
    links = pairs.select(x.alias("a"), y.alias("b")).where("a <> b")
    links = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    links, seen = scratch.write(links)
    levels: list[DataFrame] = []
    most = math.log(seen["rows"] + 2)
    while seen["rows"] > TAIL:
        # fewer vertices have smaller shifts: later levels keep the first one's radius and cut fewer links
        cluster = _grow(links, len(levels), beta * math.log(seen["rows"] + 2) / most, seed, scratch)
        levels.append(cluster)
        of = lambda c: cluster.select(F.col("v").alias(c), F.col("c").alias(f"c{c}"))
        fewer = links.join(of("a"), "a").join(of("b"), "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
        fewer, seen = scratch.write(fewer)
        scratch.drop(links)
        links = fewer
    if seen["rows"]:
        levels.append(scratch.write(_finish(links, beta, seed))[0])
    if not levels:
        return spark.createDataFrame([], "record_id string, group_id string")
    root = levels[-1]
    for level in reversed(levels[:-1]):
        above = root.select(F.col("v").alias("c"), F.col("c").alias("top"))
        root = level.join(above, "c", "left").select("v", F.coalesce("top", "c").alias("c"))
    root, _ = scratch.write(root)
    names = root.groupBy("c").agg(F.min("v").alias("group_id"))
    return root.join(names, "c").select(F.col("v").alias("record_id"), "group_id")
