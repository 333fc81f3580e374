"""Graph operators over edge tables: components, degrees, ancestors, bounded neighbourhoods.

Edge tables hold scalars only. Loops run on the driver over rounds, never over rows; each round's
table is written to the shared folder, so a lost executor costs no earlier round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.scratch import join_sized, materialize

#: So many edges, or fewer, are joined within one task (about 20 MB); more are contracted until they are as few.
TASK_EDGES = 1 << 17


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge (a, b) once in either direction; loops go."""
    kept = edges.filter("a <> b").select("a", "b")
    return kept.unionByName(kept.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def joined(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, parent: each node of a bounded set of edges (a, b) with the smallest node that it reaches."""
    parent: dict = {}

    def root(x):  # noqa: ANN001, ANN202 - nodes are of any type that has an order
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    kind = None
    for batch in it:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    if kind is not None:
        yield pa.RecordBatch.from_arrays([pa.array(list(parent), kind), pa.array([root(x) for x in list(parent)], kind)], names=["node", "parent"])


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component: the smallest node reachable; a node without edges is its own component.

    In each round every node takes its smallest neighbour, if smaller, as parent, and its parent's
    parent; edges are redrawn between parents, and loops and repeats go. Nodes with a large share of the
    edges are joined by broadcast, so none meets in one task. When at most TASK_EDGES edges are left,
    one task joins them. Every table in between is written to the shared folder.
    """
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    kind = edges.schema["a"].dataType.simpleString()
    maps = []
    while left := edges.count():
        if left <= TASK_EDGES:
            maps.append(materialize(edges.repartition(1).mapInArrow(joined, f"node {kind}, parent {kind}"), "parents"))
            break
        near = both_ways(edges).groupBy("a").agg(F.min("b").alias("low"))
        parent = materialize(near.select(F.col("a").alias("node"), F.least("a", "low").alias("parent")), "parents")
        grand = parent.select(F.col("node").alias("parent"), F.col("parent").alias("root"))
        up = materialize(parent.groupBy("parent").agg(F.count("*").alias("n")).join(grand, "parent"), "grandparents")
        parent = materialize(join_sized(parent, up, ["parent"], "n").select("node", F.col("root").alias("parent")), "parents")
        maps.append(parent)
        for end in ("a", "b"):
            to = materialize(edges.groupBy(end).agg(F.count("*").alias("n")).join(parent.withColumnRenamed("node", end), end), "ends")
            edges = join_sized(edges, to, [end], "n").drop(end, "n").withColumnRenamed("parent", end)
        edges = materialize(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    label = None
    for parent in reversed(maps):
        if label is None:
            label = parent.withColumnRenamed("parent", "root")
            continue
        known = label.select(F.col("node").alias("parent"), "root")
        to = materialize(parent.groupBy("parent").agg(F.count("*").alias("n")).join(known, "parent", "left").withColumn("root", F.coalesce("root", "parent")), "roots")
        label = materialize(join_sized(parent, to, ["parent"], "n").select("node", "root"), "labels")
    own = nodes.select("node").distinct()
    if label is None:
        return own.withColumn("component", F.col("node"))
    # parents fall from round to round, so a root is the smallest of its component
    return own.join(label, "node", "left").select("node", F.coalesce("root", "node").alias("component"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, degree: distinct neighbours, 0 for isolated nodes."""
    counted = both_ways(edges).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"))
    return nodes.select("node").distinct().join(counted, "node", "left").select("node", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def min_degree(degree: DataFrame) -> DataFrame:
    """One row, min_degree: the rounded exclusive first quartile of positive degrees, at least 1; 1 for fewer than four.

    Degrees are counted by value first; the two order statistics come from cumulative counts over one
    row for each different degree, so no value is repeated and none is capped.
    """
    values = degree.filter("degree > 0").groupBy("degree").agg(F.count("*").alias("n"))
    total, at = F.sum("n").over(Window.partitionBy()), F.lit(0.25) * (F.col("total") + 1)
    below = F.sum("n").over(Window.orderBy("degree").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    low = F.least(F.greatest(F.floor(at), F.lit(1)), F.col("total") - 1)
    ranked = values.select("degree", below.alias("upto"), total.alias("total")).withColumn("low", low).withColumn("part", at - F.col("low"))
    first, second = (F.min(F.when(F.col("upto") >= F.col("low") + k, F.col("degree"))) for k in (0, 1))
    found = ranked.agg(F.max("total").alias("total"), F.max("part").alias("part"), first.alias("first"), second.alias("second"))
    value = F.greatest(F.lit(1), F.bround(F.col("first") + F.col("part") * (F.col("second") - F.col("first"))).cast("long"))
    return found.select(F.when(F.coalesce("total", F.lit(0)) < 4, F.lit(1)).otherwise(value).cast("long").alias("min_degree"))


def ancestors(edges: DataFrame) -> DataFrame:
    """node, ancestor: every pair joined by a path of child -> parent edges, once however many paths there are."""
    step = edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor")).distinct()
    known = frontier = materialize(step, "ancestors")
    while not frontier.isEmpty():
        up = frontier.join(step.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("next")), "ancestor").select("node", F.col("next").alias("ancestor")).distinct()
        frontier = materialize(up.join(known, ["node", "ancestor"], "left_anti"), "ancestors")
        known = known.unionByName(frontier)
    return known


def neighbourhood(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """node, distance: what lies within ``depth`` edges of the start nodes, either way."""
    around = both_ways(edges)
    seen = start.select("node", F.lit(0).alias("distance")).distinct()
    for d in range(1, depth + 1):
        reached = seen.filter(F.col("distance") == d - 1).join(around, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
        seen = materialize(seen.unionByName(reached.join(seen, "node", "left_anti").withColumn("distance", F.lit(d))), "reached")
    return seen


def edge_weight(provenances: Column, mean_strength: Column, chunks: Column) -> Column:
    """1 for each provenance, half the mean strength, and up to a half for shared chunks."""
    return F.round(provenances + 0.5 * mean_strength + 0.5 * (1 - 1 / (1 + chunks)), 6)
