"""Bridges: edges without which their ends are in different components.

A spanning forest of a graph, and one of the edges that it leaves over, hold the same bridges as the
graph itself, and of such certificates' union the same is true. So each task keeps two forests of its
edges, whatever their number; what several tasks have kept is dealt to fewer. Between rounds, nodes
that lie on a common cycle within a task are contracted, which leaves bridges as they are. One task
takes the depth-first low links of what is left, at most TASK_EDGES edges unless long cycles run
through more nodes than that.

Loops and null ends go; an edge that is given twice, or either way, is one edge.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import graph
from lectern.operators.communities import attached
from lectern.operators.scratch import materialize

TASK_EDGES = 1 << 17


class Forests:
    """Two edge-disjoint forests of the edges that come by."""

    def __init__(self) -> None:
        self.parents: tuple[dict, dict] = ({}, {})

    def keeps(self, a, b) -> bool:  # noqa: ANN001 - nodes are of any type that has an order
        for parent in self.parents:
            x, y = self.root(parent, a), self.root(parent, b)
            if x != y:
                parent[x] = y
                return True
        return False

    @staticmethod
    def root(parent: dict, x):  # noqa: ANN001, ANN205
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x


def rows_of(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in it:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def low_links(edges: list[tuple]) -> tuple[list[int], dict]:
    """(the places of the bridges in ``edges`` (a, b, thick, ...), node -> a node of its class): classes are what is left without bridges. A thick edge is never one."""
    near: dict = {}
    for k, (a, b, *_) in enumerate(edges):
        near.setdefault(a, []).append((b, k))
        near.setdefault(b, []).append((a, k))
    seen, low, cut = {}, {}, []
    for start in near:
        if start in seen:
            continue
        seen[start] = low[start] = len(seen)
        path = [(start, -1, iter(near[start]))]
        while path:
            node, by, rest = path[-1]
            for other, k in rest:
                if k == by:
                    continue
                if other in seen:
                    low[node] = min(low[node], seen[other])
                    continue
                seen[other] = low[other] = len(seen)
                path.append((other, k, iter(near[other])))
                break
            else:
                path.pop()
                if path:
                    above = path[-1][0]
                    low[above] = min(low[above], low[node])
                    if low[node] > seen[above] and not edges[by][2]:
                        cut.append(by)
    bridges = set(cut)
    forest: dict = {}
    for k, (a, b, *_) in enumerate(edges):
        if k not in bridges:
            forest[Forests.root(forest, a)] = Forests.root(forest, b)
    return sorted(cut), {node: Forests.root(forest, node) for node in list(forest)}


def bridges(edges: DataFrame) -> DataFrame:
    """a, b (a < b) of every bridge of ``edges`` (a, b)."""
    kind = edges.schema["a"].dataType.simpleString()
    type_ = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind]
    columns = ("a", "b", "thick", "first", "second")
    schema = f"a {kind}, b {kind}, thick boolean, first {kind}, second {kind}"
    arrow = pa.schema([("a", type_), ("b", type_), ("thick", pa.bool_()), ("first", type_), ("second", type_)])

    def kept(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forests = Forests()
        for batch in it:
            keep = [thick or forests.keeps(a, b) for a, b, thick, _, _ in rows_of(iter([batch]))]
            yield from pa.Table.from_batches([batch]).filter(pa.array(keep, pa.bool_())).to_batches()

    def classes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, of = low_links(list(rows_of(it)))
        pairs = [(a, b) for a, b in of.items() if a != b]
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], type_) for k in (0, 1)], names=["a", "b"])

    def last(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(rows_of(it))
        cut, _ = low_links(held)
        yield pa.RecordBatch.from_pylist([dict(zip(columns, held[k], strict=True)) for k in cut], arrow)

    pairs = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = materialize(pairs.select("a", "b", F.lit(False).alias("thick"), F.col("a").alias("first"), F.col("b").alias("second")).mapInArrow(kept, schema), "certificate")
    n_parts = None
    while (n := left.count()) > TASK_EDGES and n_parts != 1:
        n_parts = max(1, min(-(-n // TASK_EDGES), n_parts // 2 if n_parts else n))
        dealt = materialize(left.repartitionByRange(n_parts, "a", "b").mapInArrow(kept, schema), "certificate")
        found = materialize(dealt.repartitionByRange(n_parts, "a", "b").mapInArrow(classes, f"a {kind}, b {kind}"), "cycles")
        ends = dealt.select(F.col("a").alias("node")).union(dealt.select("b")).distinct()
        labels = materialize(graph.components(ends, found), "classes")
        for end in ("a", "b"):
            dealt = attached(dealt, labels.select(F.col("node").alias(end), "component"), end).drop(end).withColumnRenamed("component", end)
        # edges between the same two classes are a cycle together: one of them goes on, marked
        same = dealt.filter("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        left = materialize(same.agg((F.max("thick") | (F.count("*") > 1)).alias("thick"), F.min(F.struct("first", "second")).alias("e")).select("a", "b", "thick", "e.first", "e.second"), "certificate")
    return left.repartition(1).mapInArrow(last, schema).select(F.least("first", "second").alias("a"), F.greatest("first", "second").alias("b"))


def thin_bridges(edges: DataFrame) -> DataFrame:
    """node, a, b: every end of a bridge with the first bridge, in order of its ends, that it lies on."""
    found = materialize(bridges(edges), "bridges")
    ends = found.select(F.explode(F.array("a", "b")).alias("node"), F.struct("a", "b").alias("e"))
    return ends.groupBy("node").agg(F.min("e").alias("e")).select("node", "e.a", "e.b")
