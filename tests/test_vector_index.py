"""The inverted file against all pairs: exact whatever the lists, recall of probed lists, odd rows."""

from __future__ import annotations

import numpy as np
import pytest

from lectern.operators import vector_index as index

SCHEMA = "id long, embedding array<float>, list int, v string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "x") for i, v in rows], SCHEMA)


def brute(rows, threshold, k):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = set()
    for i, a in good:
        near = sorted((-round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 5), j) for j, b in good if j != i)
        out |= {(i, j, r) for r, (s, j) in enumerate([x for x in near if -x[0] >= threshold][:k], 1)}
    return out


def clustered(rng, n, dim=16):
    centres = rng.standard_normal((12, dim))
    return [(k, (centres[k % 12] + 0.5 * rng.standard_normal(dim)) * rng.uniform(0.1, 9)) for k in range(n)]


@pytest.mark.parametrize("list_rows", [4096, 40])
def test_exact_edges(spark, monkeypatch, list_rows):
    monkeypatch.setattr(index, "LIST_ROWS", list_rows)
    monkeypatch.setattr(index, "MEMBER_BLOCK", 70)
    monkeypatch.setattr(index, "QUERY_BLOCK", 50)
    rows = clustered(np.random.default_rng(3), 400)
    rows += [(1000 + k, rows[5][1]) for k in range(100)]  # a group of copies
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [None] * 16), (2003, [np.nan] * 16), (None, rows[0][1])]
    got = {(r.query, r.doc, r["rank"]) for r in index.similarity_edges(table(spark, rows), 0.6, 10).collect()}
    assert got == brute(rows, 0.6, 10)
    pairs = {(r.a, r.b) for r in index.near_pairs(table(spark, rows), 0.9).collect()}
    assert pairs == {(i, j) for i, j, _ in brute(rows, 0.9, 10**6) if i < j}


def test_lists_out_of_reach_are_not_read(spark, monkeypatch):
    monkeypatch.setattr(index, "LIST_ROWS", 40)
    rows = index.unit(table(spark, [(k, v) for k, v in clustered(np.random.default_rng(3), 480)]))
    centroids = index.fit(rows, 12)
    radii = np.full(12, 0.4)
    assert index.probing(rows, centroids, radii, 0.9, None).count() < 480 * 6
    assert index.probing(rows, centroids, radii, -1.0, 3).count() == 480 * 3


def test_recall_of_probed_lists(spark, monkeypatch):
    monkeypatch.setattr(index, "LIST_ROWS", 20)
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("vec_id AS id", "embedding")
    asked = vectors.filter("id % 50 = 0")
    exact = {(r.query, r.doc) for r in index.neighbours(vectors, asked, 0.25, 10).collect()}
    probed = {(r.query, r.doc) for r in index.similarity_edges(vectors, 0.25, 10, probes=64).filter("query % 50 = 0").collect()}
    assert len(exact & probed) >= 0.9 * len(exact) > 300


def test_empty_and_anchors(spark):
    assert index.similarity_edges(table(spark, []), 0.5).count() == 0
    counts = spark.createDataFrame([(1, "b", 3), (1, "a", 3), (1, "c", 9), (2, "a", 1), (2, "b", 2), (3, "a", 1)], "doc long, term string, tf long")
    terms = spark.createDataFrame([("a", [1.0, 0.0]), ("c", [0.0, 1.0])], "term string, v array<double>")
    anchors = spark.createDataFrame([(1, [1.0, 0.1]), (2, None)], "doc long, anchor array<double>")
    got = sorted(tuple(r) for r in index.anchor_ranked(counts, terms, anchors, 2, pool=3).collect())
    assert got == sorted([(1, "a", 0.99504, 1), (1, "c", 0.0995, 2), (2, "b", 0.0, 1), (2, "a", 0.0, 2), (3, "a", 0.0, 1)])
    assert {(r.doc, r.term) for r in index.anchor_ranked(counts, terms, anchors, 9, pool=1).collect()} == {(1, "c"), (2, "b"), (3, "a")}


def test_blocks_send_no_more_than_the_best(spark):
    rows = clustered(np.random.default_rng(4), 300)
    rows += [(k, rows[7][1]) for k in (7, 7, 1000, 1001, 1002)]  # copies, some of one identifier
    got = index.similarity_edges(table(spark, rows), 0.3, 2)
    assert {(r.query, r.doc) for r in got.filter("query <> 7").collect()} == {(i, j) for i, j, _ in brute(rows, 0.3, 2) if i != 7}
    assert {r.doc for r in got.filter("query = 7").collect()} == {1000}  # each of the three rows of 7 ranks it first
