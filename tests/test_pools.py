"""Terms of pools by vectors: each row against plain sums, whatever the batches; odd anchors; what is shuffled."""

from __future__ import annotations

import numpy as np
import pytest

from lectern.operators import pools

SCHEMA = "doc long, terms array<string>"


def brute(rows, anchors, k):
    have = {d: np.array([np.nan if x is None else x for x in a or []] + [np.nan] * (3 - len(a or []))) for d, a in anchors}
    vectors = {}
    for d, terms in rows:
        for t in terms if d in have else ():
            vectors.setdefault(t, []).append(have[d])
    out = set()
    for d, terms in rows:
        if d not in have:
            out |= {(d, t, 0.0, r) for r, t in enumerate(terms[:k], 1)}
            continue
        a, scored = np.nan_to_num(have[d]), []
        for t in terms:
            m = np.array(vectors[t])
            v = np.nan_to_num(m).sum(axis=0) / np.maximum(1, (~np.isnan(m)).sum(axis=0))
            scale = np.sqrt(v @ v) * np.sqrt(a @ a)
            scored.append((-round(float(v @ a / scale), 5) if scale else 0.0, t))
        out |= {(d, t, -s + 0.0, r) for r, (s, t) in enumerate(sorted(scored)[:k], 1)}
    return out


@pytest.mark.parametrize("batch_docs", [4096, 7])
def test_ranks_by_anchors(spark, batch_docs):
    rng = np.random.default_rng(2)
    words = [f"w{k:02d}é" for k in range(40)]
    rows = [(d, [str(x) for x in rng.choice(words, rng.integers(1, 9), replace=False)]) for d in range(60)]
    rows += [(100, ["alone", "w01é"]), (101, ["zero", "w02é"]), (102, ["void", "b", "a"]), (None, ["x", "a"])]
    anchors = [(d, [float(x) for x in rng.standard_normal(3)]) for d in range(0, 60, 2)]
    anchors += [(100, [1.0, None, 2.0]), (101, [0.0, 0.0, 0.0]), (102, None), (999, [1.0, 1.0, 1.0])]
    got = pools.pool_ranked(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(anchors, "doc long, anchor array<float>"), 4, batch_docs)
    want = brute(rows, [(d, None if a is None else [None if x is None else float(np.float32(x)) for x in a]) for d, a in anchors], 4)
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) == len(want) and set(found) == want
    none = pools.pool_ranked(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], "doc long, anchor array<float>"), 4)
    assert {tuple(r) for r in none.collect()} == brute(rows, [], 4)


def test_pools_are_taken_in_place(spark):
    docs = spark.createDataFrame([(1, "bbb bbb aaa ccc"), (2, None), (3, "the 12"), (4, "zzz")], "doc_id long, text string")
    got = pools.pools(docs, ["the"], 2)
    assert sorted((r.doc, r.terms) for r in got.collect()) == [(1, ["bbb", "aaa"]), (4, ["zzz"])]
    assert "Exchange" not in got._jdf.queryExecution().toString()


def shuffled_rows(spark):
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_terms_are_shuffled_once_a_batch(spark, tmp_path):
    """The query sends far fewer rows than there are terms of documents with an anchor."""
    from lectern.plans import vectors

    rows = [(d, " ".join(f"{a}{b}word" for a in "abcdefg" for b in "abcdefg")) for d in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, [1.0] * 63 + [float(d)]) for d in range(400)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    before = shuffled_rows(spark)
    out = vectors.anchor_ranked_terms(spark, str(tmp_path)).collect()
    assert len(out) == 400 * 15
    assert 0 < shuffled_rows(spark) - before < 4000  # 400 times 49 terms
