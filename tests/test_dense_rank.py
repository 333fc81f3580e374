"""Dense ranking by blocks against the plain cosine of every pair: ties, odd vectors, blocks that do not divide."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions.vectors import cosine
from lectern.operators import retrieve


def plain(vectors, queries, k):
    asked = queries.select(F.col("id").alias("query"), F.col("embedding").alias("q"))
    pairs = vectors.select(F.col("id").alias("doc"), "embedding").join(asked, F.col("doc") != F.col("query"))
    scored = pairs.select("query", "doc", F.round(cosine(F.col("embedding"), F.col("q")), 5).alias("score"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


@pytest.mark.parametrize("member_block", [7, 32768])
def test_blocks_rank_as_all_pairs(spark, monkeypatch, member_block):
    monkeypatch.setattr(retrieve, "MEMBER_BLOCK", member_block)
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 5)
    monkeypatch.setattr(retrieve, "SCORES", 20)
    r = random.Random(1)
    rows = [(k, [r.gauss(0, 1) for _ in range(4)]) for k in range(60)] + [(k, [1.0, 0.0, 2.0, 0.0]) for k in range(60, 80)]
    rows += [(80, None), (81, [0.0] * 4), (82, [1.0, None, 2.0, 3.0]), (83, [1.0, 2.0]), (84, []), (85, [math.nan, 1.0, 1.0, 1.0]), (None, [1.0] * 4)]
    vectors = spark.createDataFrame(rows, "id long, embedding array<float>")
    queries = vectors.filter("id % 5 < 3 OR id >= 80")
    got, want = ({tuple(map(str, x)) for x in rank(vectors, queries, 6).collect()} for rank in (retrieve.dense_rank, plain))
    assert (got - want, want - got) == (set(), set())
    assert retrieve.dense_rank(vectors.filter("id < 0"), queries, 6).count() == 0


def test_pairs_are_no_rows(spark):
    vectors = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(9)], "id long, embedding array<float>")
    assert "NestedLoopJoin" not in retrieve.dense_rank(vectors, vectors, 2)._jdf.queryExecution().executedPlan().toString()
