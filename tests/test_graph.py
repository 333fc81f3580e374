"""Graph operators against plain versions."""

from __future__ import annotations

import random
import statistics

from pyspark.sql import functions as F

from lectern.operators import graph


def test_min_degree_of_millions_of_equal_degrees(spark):
    degree = spark.range(5_200_000).select(F.when(F.col("id") < 1_200_000, 1).otherwise(10).cast("long").alias("degree"))
    assert [r.min_degree for r in graph.min_degree(degree).collect()] == [10]


def test_min_degree_is_the_exclusive_quartile(spark):
    rng = random.Random(3)
    for n in (0, 3, 4, 5, 6, 7, 50, 201):
        values = [rng.randrange(1, 12) for _ in range(n)]
        got = graph.min_degree(spark.createDataFrame([(v,) for v in [*values, 0, 0]], "degree long")).collect()
        want = max(1, round(statistics.quantiles(values, n=4, method="exclusive")[0])) if n >= 4 else 1
        assert [r.min_degree for r in got] == [want]


def test_components_by_contraction_and_at_once(spark, monkeypatch):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(7, 7), (500, 501), (501, 500)]
    nodes = sorted({x for e in edges for x in e} | {999})
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    want = sorted((n, root(n)) for n in nodes)
    table = [(n,) for n in nodes]
    for bound in (graph.TASK_EDGES, 0):
        monkeypatch.setattr(graph, "TASK_EDGES", bound)
        got = graph.components(spark.createDataFrame(table, "node long"), spark.createDataFrame(edges, "a long, b long"))
        assert sorted((r.node, r.component) for r in got.collect()) == want
    none = graph.components(spark.createDataFrame([(3,)], "node long"), spark.createDataFrame([], "a long, b long"))
    assert [(r.node, r.component) for r in none.collect()] == [(3, 3)]
