"""Connected components of an edge table by alternating stars, on DataFrames alone."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import stage, tidy

MAX_ROUNDS = 60
#: Tables of a row per node up to so many (16 bytes each) are broadcast.
BROADCAST_NODES = 500_000
#: Nodes of so many edges are hot: of E edges at most 2 E / HOT nodes are, which are joined by broadcast, and so by no one task.
HOT = 100_000
#: Edges that a task contracts (16 bytes each); a table of no more is contracted by one task, and that settles it.
EDGES_A_TASK = 200_000


def _spanning(batches):
    """The components of a task's own edges as stars (member, smallest member), some hundred thousand edges at a time."""
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def stars():
        rows = [(x, root(x)) for x in list(parent) if root(x) != x]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names=["u", "v"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > 500_000:
            yield stars()
    yield stars()


def _with_lowest(rows: DataFrame, low: DataFrame, few: bool) -> DataFrame:
    """``rows`` (u, v) with m from ``low`` (u, m, n: rows of u), no node's rows in one task."""
    if few:
        return rows.join(F.broadcast(low.select("u", "m")), "u")
    low = stage(low, "lowest")
    hot = F.broadcast(low.where(F.col("n") > HOT).select("u", "m"))
    cold = rows.join(hot.select("u"), "u", "left_anti").join(low.where(F.col("n") <= HOT).select("u", "m"), "u")
    return cold.unionByName(rows.join(hot, "u"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): for each node of ``edges`` the smallest node that it reaches.

    Edges are first contracted within each task. Each round links a node's larger neighbours to its smallest one (large star)
    and then its smaller neighbours (small star); the number of edges never
    grows, and the rounds follow the logarithm of the longest path. A table per
    round is written to the shared folder, so that lost executors cost one round.
    Null ends are dropped, loops and repeated edges do no harm, and an empty
    table gives an empty one.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    nodes = stage(now, "edges")
    size = nodes.count()
    tasks = -(-size // EDGES_A_TASK)
    now = nodes.coalesce(max(1, tasks)).mapInArrow(tidy(_spanning), "u long, v long")
    if tasks <= 1:
        return _labels(now)
    seen, few = None, size <= BROADCAST_NODES // 2
    for _ in range(MAX_ROUNDS):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = _with_lowest(both, low, few).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _with_lowest(large, low, few).select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        now = stage(small.where("u <> v").distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return _labels(now)


def _labels(stars: DataFrame) -> DataFrame:
    """(id, component) of stars (member, smallest member): the members, and the middles themselves."""
    return stars.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(stars.select("v", "v").distinct())
