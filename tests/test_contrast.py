"""The terms of highest contrast from few words against counting all terms: ties, terms that C-value drops or leaves open, bars that are too high."""

from __future__ import annotations

import random

import pytest

from lectern.operators import contrast, keywords, nesting

STOP = ["the", "of"]


def table(spark, seed):
    r = random.Random(seed)
    words = ["the", "of", "a1", "ab", "zo", "x9999", "1234", "graph", "graphs", "3.5", "the.2", "é", *(f"w{k}" for k in range(40))]
    weights = [1 + 60 // (1 + k) for k in range(len(words))]
    passage = "only here stand such words"
    rows = [(k, " ".join([*r.choices(words, weights, k=r.randrange(0, 60)), *([passage] * (k % 3 == 0))])) for k in range(80)]
    return spark.createDataFrame([*rows, (80, None), (81, ""), (82, rows[3][1]), (83, "zo zo zo zo"), (84, "one")], "doc_id long, text string").repartition(3)


def reference(spark):
    return spark.createDataFrame([("graph", 3.25), ("zo", 9.0), ("ab", 0.5), ("only", 1.0), (None, 2.0)], "token string, zipf double")


@pytest.mark.parametrize(("seed", "k", "least", "batch"), [(1, 15, 0.0, 1 << 20), (2, 3, 30.0, 60), (3, 60, 4.5, 60), (4, 2000, 0.0, 60), (6, 15, 1e9, 60)])
def test_strongest_terms(spark, monkeypatch, seed, k, least, batch):
    monkeypatch.setattr(nesting, "BATCH_TOKENS", batch)
    monkeypatch.setattr(contrast, "FIRST_WORDS", 1)
    docs = table(spark, seed)
    want = keywords.contrastive(keywords.c_values(docs, STOP), reference(spark), k, min_cvalue=least)
    got = contrast.strongest(docs, reference(spark), STOP, k, min_cvalue=least)
    assert got.collect() == want.collect() and got.schema == want.schema


def test_terms_left_open_are_counted(spark, monkeypatch):
    monkeypatch.setattr(nesting, "BATCH_TOKENS", 60)
    docs = table(spark, 7)
    bounds = contrast.term_bounds(docs, frozenset(["here", "stand", "w1", "w2", "graph", "graphs"]), STOP, "text", 3)
    bounds = bounds.withColumn("low", contrast.c_value_of("least")).withColumn("high", contrast.c_value_of("most"))
    exact = keywords.c_values(docs, STOP)
    joined = bounds.join(exact.withColumnRenamed("freq", "f"), "term").collect()
    assert len(joined) == bounds.count() > 4 and all(r.freq == r.f and r.low <= r.cvalue <= r.high for r in joined)
    assert any(r.low < r.high for r in joined)
    names = frozenset(r.term for r in joined)
    n = contrast.holders(docs, names, STOP, "text", 3)
    left = bounds.join(n, "term", "left").fillna(0, ["n"]).withColumn("c", contrast.c_value_of("n")).join(exact.select("term", "cvalue"), "term")
    assert left.count() == len(joined) and left.filter("c <> cvalue").count() == 0


def test_few_terms_are_counted(spark, monkeypatch):
    docs = table(spark, 8)
    want = keywords.contrastive(keywords.c_values(docs, STOP), reference(spark)).collect()
    calls, real = [], nesting.nested
    monkeypatch.setattr(nesting, "nested", lambda *a, **b: calls.append(a) or real(*a, **b))
    assert contrast.strongest(docs, reference(spark), STOP).collect() == want and not calls
    monkeypatch.setattr(contrast, "MOST_WORDS", 2)  # with more words than tasks may hold, all terms are counted
    assert contrast.strongest(docs, reference(spark), STOP).collect() == want and len(calls) == 1
    empty = docs.filter("doc_id < 0")
    monkeypatch.undo()
    assert contrast.strongest(empty, reference(spark), STOP).count() == 0


def test_query_counts_few_terms(spark, monkeypatch):
    from lectern.plans import catalogue

    def refuse(*a, **b):
        raise AssertionError("all terms are counted")

    monkeypatch.setattr(nesting, "nested", refuse)
    assert catalogue.QUERIES["contrastive_keywords"](spark, "/root/testdata/sf0.001").count() == 15
