"""Collision counting against all inner products: exact scores, ties, copies, odd rows, recall."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, k0 long, vector string, rank int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 5, "v", 2) for i, v in rows], SCHEMA)


def brute(rows):
    """query id -> [(score, vec_id)], all candidates in order."""
    good = {(i, tuple(np.float32(x).item() for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, v in good:
        if i % neighbours.QUERY_STEP == 0:
            others = [(-sum_in_order(v, w), j) for j, w in good if len(w) == len(v) and (j, w) != (i, v)]
            out.setdefault(i, []).append([(j, -s) for s, j in sorted(others)[: neighbours.TOP]])
    return out


def sum_in_order(a, b):
    s = 0.0
    for x, y in zip(a, b, strict=True):
        s += x * y
    return s


def got(spark, rows):
    out = {}
    for r in sorted(neighbours.search(table(spark, rows)).collect(), key=lambda r: r["rank"]):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_all_candidates_where_there_are_few(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-3.0, 1.0]), (3, [0.5, 0.5]), (20, [0.0, -1.0]), (40, [0.5, 0.5]), (41, [-0.0, -1.0])]
    rows += [(4, None), (5, [0.0, -0.0]), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, []), (None, [1.0, 1.0]), (60, None), (80, [0.0, 0.0])]
    rows += [(10, [1.0, 1.0, 1.0]), (100, [1.0, 2.0, 3.0]), (1, [0.5, 0.5]), (120, [2.0])]
    assert got(spark, rows) == {i: v[0] for i, v in brute(rows).items() if v[0]}
    assert got(spark, []) == {}


def test_copies_and_ties(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [1.0, 2.0, 2.0]) for k in range(0, 900)] + [(k, [2.0, 1.0, 2.0]) for k in range(900, 960)]
    rows += [(k, rng.standard_normal(3).round(1).tolist()) for k in range(1000, 1200)]
    rng.shuffle(rows := [(int(i), list(v)) for i, v in rows])
    assert got(spark, rows) == {i: v[0] for i, v in brute(rows).items()}


@pytest.mark.parametrize("spread", [0.0, 2.0])
def test_recall(spark, monkeypatch, spread):
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 1500)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 70)
    rng = np.random.default_rng(6)
    x = rng.standard_normal((4000, 32))
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True)) * np.exp(spread * rng.standard_normal((4000, 1)))
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    found, want = got(spark, rows), brute(rows)
    assert found.keys() == want.keys()
    hits = [len({j for j, _ in found[i]} & {j for j, _ in v[0]}) for i, v in want.items()]
    assert sum(hits) / (neighbours.TOP * len(hits)) >= 0.95
    score = {i: dict(v) for i, v in found.items()}
    assert all(score[i][j] == s for i, v in want.items() for j, s in v[0] if j in score[i])
    assert all(len(v) == neighbours.TOP and [s for _, s in v] == sorted((s for _, s in v), reverse=True) for v in found.values())


def test_recall_on_given_vectors(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    ids, x = (np.array(c) for c in zip(*((r.vec_id, r.embedding) for r in vectors.collect()), strict=True))
    found = {}
    for r in neighbours.search(vectors).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for k in np.flatnonzero(ids % neighbours.QUERY_STEP == 0):
        scores = x @ x[k]
        scores[k] = -np.inf
        hits += len(found[ids[k]] & set(ids[np.lexsort((ids, -scores))[: neighbours.TOP]].tolist()))
    assert hits / (neighbours.TOP * len(found)) >= 0.97


def test_few_are_verified_where_neighbours_are_near(monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((50, 64))
    x = np.repeat(centres, 40, axis=0) + 0.2 * rng.standard_normal((2000, 64))
    verified = []
    verify = neighbours.Answer.verify
    monkeypatch.setattr(neighbours.Answer, "verify", lambda self, band, found, firsts: (verified.append(len(found)), verify(self, band, found, firsts)))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    answers = neighbours.nearest(x, np.arange(len(x)), x[::20])
    want = np.argsort(-(x[::20] @ x.T), axis=1)[:, : neighbours.TOP + 1]
    assert np.mean([len(set(a.rows) & set(w)) for a, w in zip(answers, want, strict=True)]) >= 0.95 * (neighbours.TOP + 1)
    assert sum(verified) < 0.1 * len(answers) * len(x)


def test_scores_of_query(spark):
    from lectern.llm.queries import QUERIES

    path = "/root/testdata/sf0.001"
    out = QUERIES["op11_nearest_neighbours"](spark, path)
    vectors = spark.read.parquet(f"{path}/embeddings.parquet")
    assert out.dtypes[:4] == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    joined = out.join(vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("a")), "query_id").join(vectors.select("vec_id", F.col("embedding").alias("b")), "vec_id")
    assert joined.filter(dot != F.col("score")).count() == 0 and joined.count() == 25 * 20
