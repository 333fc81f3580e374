"""Ranking of documents where they stand against the ranking of joined postings, with phrases of several parts, odd rows and small blocks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import index, scoring, store
from lectern.operators.scratch import scratch_path


def tables(spark):
    r = random.Random(2)
    words = ["ab", "cd", "3.5", "3", "5", "x/9", "x", "9", "zz", "a-b", "ef"]
    rows = [(k, " ".join(r.choice(words) for _ in range(r.randrange(0, 12))), k % 3) for k in range(120)]
    docs = spark.createDataFrame([*rows, (200, None, 0), (201, "", 1), (202, rows[7][1], 0), (203, "5.3.5", None)], "doc_id long, text string, part long")
    asked = [(k, " ".join(r.choice(words) for _ in range(4))) for k in range(9)] + [(20, None), (21, "unknown"), (22, "3.5 3.5 x/9")]
    return docs.repartition(3), spark.createDataFrame(asked, "item_id long, text string")


def rows(frame):
    return {(r.query, r.doc, round(r.score, 6), r["rank"]) for r in frame.collect()}


@pytest.mark.parametrize("scope", [None, "part = 0"])
def test_documents_rank_as_postings(spark, monkeypatch, scope):
    docs, queries = tables(spark)
    inside = None if scope is None else F.expr(scope)
    where = scratch_path(spark, "index")
    store.fill(docs, where)
    only = None if scope is None else docs.filter(scope).select(F.col("doc_id").alias("doc"))
    monkeypatch.setattr(scoring, "SCORES", 40)
    got, stored = rows(index.bm25(docs, queries, 4, scope=inside)), rows(store.search(spark, where, queries, 4, scope=only))
    for module in (index, store):
        monkeypatch.setattr(module, "BROADCAST_PARTS", -1)
    want = rows(index.bm25(docs, queries, 4, scope=inside))
    assert got == want == stored and len(want) > 30


def test_frequent_phrases_are_no_groups(spark):
    docs, queries = tables(spark)
    plan = index.bm25(docs, queries, 4)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(phrase" not in plan and "SortMergeJoin" not in plan
    assert index.bm25(docs, queries.filter("item_id < 0"), 4).count() == index.bm25(docs.filter("doc_id < 0"), queries, 4).count() == 0
