"""Communities of a weighted graph by modularity: rounds of local moves, then contraction, again and again.

Edges (a, b, weight) are undirected; weights count in whole millionths, so sums do not depend on their
order. In a round every node of one half looks at the communities of its neighbours and moves to that
with the largest gain, at ties to the smallest; halves take turns, so neighbours seldom swap. The
best labels of a level are contracted to nodes, and levels go on until none shrinks. From at most
TASK_EDGES edges on, one task goes on by itself, node after node. Hot nodes and hot communities are
joined by broadcast; no neighbour list is gathered.

Nodes without edges are communities by themselves. Null ends and loops of the given edges go, repeated
edges add up, negative and null weights count as 0. An empty graph has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.scratch import join_sized, materialize

#: So many edges, or fewer, go on in one task (about 50 MB there).
TASK_EDGES = 1 << 17
#: Rounds of a level, and what modularity has to gain in two rounds for a third.
ROUNDS, LEAST_GAIN = 24, 1e-6
SCALE = 1_000_000


def attached(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``left`` with the columns of ``right``, which has one row for each ``key``; hot keys are broadcast."""
    sized = materialize(left.groupBy(key).agg(F.count("*").alias("_n")).join(right, key), "sized")
    return join_sized(left, sized, [key], "_n").drop("_n")


def weighed(edges: DataFrame) -> DataFrame:
    """a, b, w: each pair once, a < b, its weight in whole millionths."""
    w = F.greatest(F.coalesce(F.round(F.col("weight") * SCALE).cast("long"), F.lit(0)), F.lit(0))
    pairs = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), w.alias("w"))
    return pairs.groupBy("a", "b").agg(F.sum("w").alias("w"))


def ends(edges: DataFrame) -> DataFrame:
    """a, b, w in both directions; a loop has two rows."""
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def modularity(labels: DataFrame, edges: DataFrame, resolution: float = 1.0) -> float:
    """The modularity of ``labels`` (node, community) over ``edges`` (a, b, weight); 0 without weight."""
    both = ends(weighed(edges))
    strength = attached(both.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k")), labels, "node")
    total = strength.agg(F.sum("k")).first()[0]
    if not total:
        return 0.0
    named = attached(attached(both, labels.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a"), labels.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
    inside = named.filter("ca = cb").agg(F.sum("w")).first()[0] or 0
    spread = strength.groupBy("community").agg(F.sum("k").alias("k")).agg(F.sum(F.pow(F.col("k") / F.lit(float(total)), F.lit(2.0)))).first()[0]
    return inside / total - resolution * spread


def level(edges: DataFrame, resolution: float) -> DataFrame:
    """node, label: the labels with the best modularity that rounds of moves reach on ``edges`` (a, b, w; a loop is inside weight)."""
    both = materialize(ends(edges), "ends")
    nodes = materialize(both.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k")).withColumn("label", F.col("node")), "labels")
    total = float(nodes.agg(F.sum("k")).first()[0] or 0)
    if not total:
        return nodes.select("node", "label")
    best, best_nodes, idle = -2.0, nodes, 0
    for turn in range(ROUNDS):
        seen = attached(both, nodes.select(F.col("node").alias("b"), "label"), "b").select("a", "label", F.when(F.col("a") != F.col("b"), F.col("w")).otherwise(0).alias("w"), F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0).alias("loop"))
        own = nodes.select(F.col("node").alias("a"), "label", F.lit(0).alias("w"), F.lit(0).alias("loop"))
        near = seen.unionByName(own).groupBy("a", "label").agg(F.sum("w").alias("w"), F.sum("loop").alias("loop"))
        sums = nodes.groupBy("label").agg(F.sum("k").alias("sum"))
        near = attached(near, sums, "label").withColumnRenamed("a", "node")
        near = materialize(attached(near, nodes.select("node", "k", F.col("label").alias("own")), "node"), "near")
        stays = F.col("label") == F.col("own")
        inside = near.filter(stays).agg(F.sum(F.col("w") + F.col("loop"))).first()[0]
        spread = sums.agg(F.sum(F.pow(F.col("sum") / F.lit(total), F.lit(2.0)))).first()[0]
        now = inside / total - resolution * spread
        idle = 0 if now > best + LEAST_GAIN else idle + 1
        if now > best:
            best, best_nodes = now, nodes
        if idle == 2:
            break
        rest = F.col("sum") - F.when(stays, F.col("k")).otherwise(0)
        gain = F.col("w") * F.lit(total) - F.lit(resolution) * F.col("k") * rest
        choice = near.select("node", "k", "own", F.struct((-gain).alias("loss"), (~stays).alias("moves"), "label").alias("c")).groupBy("node", "k", "own").agg(F.min("c").alias("c"))
        in_turn = F.pmod(F.xxhash64("node"), F.lit(2)) == turn % 2
        nodes = materialize(choice.select("node", "k", F.when(in_turn, F.col("c.label")).otherwise(F.col("own")).alias("label")), "labels")
    return best_nodes.select("node", "label")


def contracted(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``edges`` between the labels of their ends; what lies within a label is its loop."""
    for end in ("a", "b"):
        edges = attached(edges, labels.select(F.col("node").alias(end), "label"), end).drop(end).withColumnRenamed("label", end)
    return materialize(edges.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").alias("w")), "contracted")


def moved(near: dict[int, dict[int, int]], loops: list[int], resolution: float) -> list[int]:
    """Labels of nodes 0, 1, ... after moves in their order until none gains."""
    strength = [sum(n.values()) + 2 * loop for n, loop in zip(near.values(), loops, strict=True)]
    total, label, held, going = sum(strength), list(range(len(strength))), list(strength), True
    while going:
        going = False
        for node, around in near.items():
            weights = {label[node]: 0}
            for other, w in around.items():
                weights[label[other]] = weights.get(label[other], 0) + w
            held[label[node]] -= strength[node]
            gain = {c: w - resolution * strength[node] * held[c] / total for c, w in weights.items()}
            to = min(gain, key=lambda c: (-gain[c], c != label[node], c))
            if gain[to] > gain[label[node]] + 1e-9 * total:
                label[node], going = to, True
            held[label[node]] += strength[node]
    return label


def in_task(edges: list[tuple], resolution: float) -> dict:
    """node -> community for a bounded graph, by moves and contraction as above."""
    names = sorted({x for a, b, _ in edges for x in (a, b)})
    number = {x: k for k, x in enumerate(names)}
    of = list(range(len(names)))
    pairs = [(number[a], number[b], w) for a, b, w in edges]
    while True:
        n = max((max(a, b) for a, b, _ in pairs), default=-1) + 1
        near: dict[int, dict[int, int]] = {k: {} for k in range(n)}
        loops = [0] * n
        for a, b, w in pairs:
            if a == b:
                loops[a] += w
                continue
            near[a][b] = near[a].get(b, 0) + w
            near[b][a] = near[b].get(a, 0) + w
        if not any(loops) and not any(any(x.values()) for x in near.values()):
            break
        label = moved(near, loops, resolution)
        kept = {c: k for k, c in enumerate(sorted(set(label)))}
        if len(kept) == n:
            break
        of = [kept[label[k]] for k in of]
        pairs = [(kept[label[a]], kept[label[b]], w) for a, b, w in pairs]
    return dict(zip(names, of, strict=True))


def communities(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """node, community: for each of ``nodes`` (node) the smallest node of its community."""
    left = materialize(weighed(edges), "edges")
    kind = left.schema["a"].dataType.simpleString()
    maps: list[DataFrame] = []

    def finish(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [row for batch in it for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        found, first = in_task(held, resolution), {}
        for node in sorted(found):
            first.setdefault(found[node], node)
        if found:
            type_ = pa.string() if isinstance(next(iter(found)), str) else pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(list(found), type_), pa.array([first[c] for c in found.values()], type_)], names=["node", "label"])

    while True:
        if left.count() <= TASK_EDGES:
            maps.append(materialize(left.select("a", "b", "w").repartition(1).mapInArrow(finish, f"node {kind}, label {kind}"), "labels"))
            break
        labels = level(left, resolution)
        if labels.agg(F.count_distinct("label") == F.count("*")).first()[0]:
            break
        maps.append(labels)
        left = contracted(left, labels)
    out = nodes.select("node").distinct().withColumn("label", F.col("node"))
    for labels in maps:
        known = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        sized = materialize(out.groupBy("label").agg(F.count("*").alias("_n")).join(known, "label", "left"), "sized")
        out = materialize(join_sized(out, sized, ["label"], "_n").select("node", F.coalesce("next", "label").alias("label")), "labels")
    first = out.groupBy("label").agg(F.min("node").alias("community"))
    return attached(out, first, "label").select("node", "community")


def in_order(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """``rows`` with ``name``: their numbers from 0 in ``order``. Rows are sorted by range; only one count a partition is summed up in one place."""
    part, within = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = materialize(rows.orderBy(*order).select("*", part.alias("_part"), within.alias("_at")), "ordered")
    counts = placed.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = counts.select("_part", (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def skeleton(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(node, degree, community) and (community, label, size).

    Communities are numbered by size, the largest first, then by their smallest node; the label is the
    node of highest degree, the largest of equal ones.
    """
    found = materialize(communities(nodes, edges, resolution), "communities")
    pairs = weighed(edges)
    degree = ends(pairs).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"))
    graded = materialize(found.join(degree, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0))), "degrees")
    groups = graded.groupBy("community").agg(F.count("*").alias("size"), F.max(F.struct("degree", "node"))["node"].alias("label"))
    numbered = in_order(groups, "number", F.desc("size"), F.asc("community"))
    members = attached(graded, numbered.select("community", "number"), "community")
    return members.select("node", "degree", F.col("number").alias("community")), numbered.select(F.col("number").alias("community"), "label", "size")
