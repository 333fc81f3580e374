"""Connected components of an edge table by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import join_sized, materialize, tidy

#: So many edges, or fewer, are joined within one task (about 20 MB); more are contracted until they are as few.
TASK_EDGES = 1 << 17


def joined(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, parent: each node of a bounded set of edges (a, b) with the smallest node that it reaches."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent.setdefault(up, up)
            x = parent[x]
        return x

    for batch in it:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    yield pa.RecordBatch.from_arrays([pa.array(list(parent), pa.int64()), pa.array([root(x) for x in list(parent)], pa.int64())], names=["node", "parent"])


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (a, b: long); the root is one of its component's nodes.

    In each round every node takes its smallest neighbour, if smaller, as parent; chains of parents
    are shortened once; edges are redrawn between parents, and what has become a loop or repeats is
    gone. A star is done after one round, and paths shrink at least by half. Hot nodes are joined as
    ``join_sized`` does. Every table in between is written to the shared folder. When at most
    TASK_EDGES edges are left, one task joins them.
    """
    edges = materialize(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    maps = []
    while left := edges.count():
        if left <= TASK_EDGES:
            maps.append(materialize(edges.repartition(1).mapInArrow(tidy(joined), "node long, parent long"), "parents"))
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("size"))
        parent = materialize(near.select(F.col("a").alias("node"), F.least("a", "low").alias("parent")), "parents")
        grand = parent.select(F.col("node").alias("parent"), F.col("parent").alias("root"))
        children = materialize(parent.groupBy("parent").agg(F.count("*").alias("n")).join(grand, "parent"), "grandparents")
        parent = materialize(join_sized(parent, children, ["parent"], "n").select("node", F.col("root").alias("parent")), "parents")
        maps.append(parent)
        for end in ("a", "b"):
            size = edges.groupBy(end).agg(F.count("*").alias("n"))
            to = materialize(size.join(parent.withColumnRenamed("node", end), end), "ends")
            edges = join_sized(edges, to, [end], "n").drop(end, "n").withColumnRenamed("parent", end)
        edges = materialize(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[-1].select("node", F.col("parent").alias("root"))
    for parent in reversed(maps[:-1]):
        # nodes that were contracted into others take the root of those
        size = parent.groupBy("parent").agg(F.count("*").alias("n"))
        to = materialize(size.join(out.withColumnRenamed("node", "parent"), "parent", "left").withColumn("root", F.coalesce("root", "parent")), "roots")
        out = materialize(join_sized(parent, to, ["parent"], "n").select("node", "root"), "roots")
    return out
