"""Rows with null or repeated identifiers: each is counted and decided by itself."""

from __future__ import annotations

import random
from collections import Counter

from lectern.llm import decontaminate, exact_dedup, jaccard_join, quality, url_filter

SCHEMA = "doc_id long, text string"
LONG = "one two three four five six seven eight nine ten"


def test_null_identifiers_have_rows_and_count(spark):
    docs = spark.createDataFrame([(None, "A b"), (4, "a b"), (9, "a B"), (None, "z"), (None, "z"), (-(2**63), "q"), (None, "q")], SCHEMA)
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs, null_ids=True).collect())
    low = -(2**63)
    assert got == Counter([(None, 9, 3, None), (4, 9, 3, False), (9, 9, 3, True), (None, None, 2, None), (None, None, 2, None), (low, low, 2, True), (None, low, 2, None)])


def test_stages_decide_by_row(spark):
    docs = spark.createDataFrame([(None, LONG), (1, LONG), (1, LONG), (1, "clean text of its own"), (None, "alone"), (None, "alone")], SCHEMA)
    want = [("1", "clean text of its own"), ("1", LONG), ("None", "alone")]
    for stage in (exact_dedup.drop_copies, jaccard_join.keep_one):
        assert sorted((str(r.doc_id), r.text) for r in stage(docs).collect()) == want
    items = spark.createDataFrame([(7, LONG)], "item_id long, text string")
    left = decontaminate.drop_contaminated(docs, items).collect()
    assert sorted((str(r.doc_id), r.text) for r in left) == [("1", "clean text of its own"), ("None", "alone"), ("None", "alone")]


def test_benchmark_in_parts_equals_whole(spark, monkeypatch):
    docs = spark.createDataFrame([(None, LONG), (1, "x " + LONG + " y Z w"), (1, "x " + LONG + " y Z w"), (2, None), (3, "z w v u")], SCHEMA)
    items = spark.createDataFrame([(k, t) for k, t in enumerate([LONG, "three four", "ten y z", "w", None, "!!", "four five six"])], "item_id long, text string")

    def found():
        return Counter(tuple(map(str, r)) for r in decontaminate.judge(decontaminate.removal_spans(docs, items)).collect())

    whole = found()
    assert sum(whole.values()) == 5
    monkeypatch.setattr(decontaminate, "BENCHMARK_BYTES", 20)
    assert found() == whole


def test_hot_grams_are_gathered_in_parts(spark, monkeypatch):
    rng = random.Random(3)
    common = [f"c{k}" for k in range(30)]
    rows = [(k, " ".join(common[: rng.randrange(20, 30)] + [f"u{k}.{j}" for j in range(rng.randrange(0, 9))])) for k in range(300)]
    plain = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_groups(spark.createDataFrame(rows, SCHEMA)).collect())
    monkeypatch.setattr(jaccard_join, "BUCKET_POSTINGS", 50)
    monkeypatch.setattr(jaccard_join, "BLOCK_GRAMS", 400)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_groups(spark.createDataFrame(rows, SCHEMA)).collect()) == plain


def test_quality_of_rows_without_or_with_repeated_identifiers(spark):
    ids = [r.id for r in spark.range(60).filter(~quality.held_out("id")).limit(8).collect()]
    docs = [(i, ("plain words of a line " if k % 2 else "X9 ## $$ ") * 30) for k, i in enumerate(ids)]
    docs += [(None, "plain words of a line"), (None, None), docs[0]]
    labels = [(i, k % 2) for k, i in enumerate(ids)] + [(ids[1], 0), (None, 1), (ids[2], 7), (ids[3], None)]
    table = spark.createDataFrame(docs, SCHEMA)
    models = [quality.fit(table, spark.createDataFrame(rows, "doc_id long, quality int")) for rows in (labels, labels[::-1])]
    assert len(models[0].labels) == 9 and models[0].labels.tolist() == models[1].labels.tolist()
    assert models[0].labels.sum() == 3  # the second identifier has both labels
    got = quality.score(table, models[0]).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)


def test_urls_of_rows_without_or_with_repeated_identifiers(spark):
    rows = [(None, "http://a.net/x"), (1, None), (1, None), (2, "http://a.net/x"), (2, "http://a.net/x")]
    got = Counter((r.page_id, r.host, r.rule, r.verdict) for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect())
    assert got == Counter({(None, "a.net", "net/", "block"): 1, (1, "", None, "allow"): 2, (2, "a.net", "net/", "block"): 2})


def test_pipeline_stages_on_empty_and_odd_tables(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, LONG)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    odd = [(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "the same line of words", "en", "s", 3), (2, "the same line of words", "en", "s", 3), (3, "das ist ein anderer text hier", "de", "s", 3)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, str(tmp_path))
            assert after.columns == docs.columns and after.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(rows)
