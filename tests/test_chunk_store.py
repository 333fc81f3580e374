"""Stored chunks: only the buckets of a list of documents are read; long lists, hot documents, odd rows."""

from __future__ import annotations

from lectern.operators import chunk_store


def test_only_own_buckets_are_read(spark, tmp_path, monkeypatch):
    where = str(tmp_path / "chunks")
    chunks = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('d', id % 200) END AS doc_hash", "CAST(id AS int) AS place", "concat('text ', id) AS text", "id % 4 AS page", "CASE WHEN id % 5 > 0 THEN array(CAST(id AS double), 1.0D) END AS vector")
    odd = spark.createDataFrame([(None, 1, "gone", 0, None), ("empty", 0, None, None, None)], "doc_hash string, place int, text string, page long, vector array<double>")
    chunk_store.write(chunks.unionByName(odd), where, buckets=16)
    wanted = spark.createDataFrame([("d7",), ("d8",), ("d8",), ("none",), (None,)], "doc_hash string")
    got = chunk_store.of_documents(spark, where, wanted, buckets=16)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "In(doc_hash" in plan
    want = {(r.doc_hash, r.place) for r in chunks.filter("doc_hash IN ('d7', 'd8')").collect()}
    assert {(r.doc_hash, r.place) for r in got.collect()} == want and got.count() == len(want)
    assert len(got.inputFiles()) < len(spark.read.parquet(where).inputFiles()) / 2 or got.selectExpr("input_file_name()").distinct().count() <= 3
    monkeypatch.setattr(chunk_store, "NAMED", 1)
    every = spark.createDataFrame([("d7",), ("hot",), ("d8",)], "doc_hash string")
    assert chunk_store.of_documents(spark, where, every, buckets=16).count() == len(want) + 1000
    assert chunk_store.of_documents(spark, where, every.limit(0), buckets=16).count() == 0
    sizes = {r.doc_hash: (r.n_chunks, r.n_pages) for r in chunk_store.sizes(spark, where).collect()}
    assert sizes["hot"] == (1000, 4) and sizes["empty"] == (1, 0) and None not in sizes
    vectors = {r.doc_hash: r.v for r in chunk_store.document_vectors(spark, where, 2).collect()}
    assert "empty" not in vectors and vectors["d7"][1] == 1.0
