"""The stored index: deletes, refills, compaction, rebuilding, what breaks off, odd rows, hot terms."""

from __future__ import annotations

import pytest

from lectern.operators import index, store

SCHEMA = "doc_id long, text string, term string, bucket int"
WORDS = "common alpha beta gamma delta epsilon zeta eta".split()


def table(spark, rows):
    return spark.createDataFrame([(i, t, "t", 1) for i, t in rows], SCHEMA)


def corpus():
    return [(k, "common " + " ".join(WORDS[(k * j) % len(WORDS)] for j in range(1, 2 + k % 9))) for k in range(60)] + [(60, None), (61, "")]


@pytest.fixture
def asked(spark):
    return spark.createDataFrame([(1, "common alpha"), (2, "beta gamma zeta"), (3, "nothing")], "item_id long, text string")


def ranks(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_deletes_compaction_and_refills_rank_as_without_a_store(spark, tmp_path, asked, monkeypatch):
    where, rows = str(tmp_path), corpus()
    docs = table(spark, rows)
    assert store.fill(docs.filter("doc_id < 40"), where) == 40 and store.fill(docs, where) == 22
    gone = spark.createDataFrame([(k,) for k in (3, 4, 50, 50, 999, None)], "doc long")
    assert store.delete(spark, where, gone) == 3 and store.delete(spark, where, gone) == 0
    left = table(spark, [r for r in rows if r[0] not in (3, 4, 50)])
    want = ranks(index.bm25(left, asked, 7))
    assert ranks(store.search(spark, where, asked, 7)) == want
    assert store.fill(table(spark, [rows[3]]), where, buckets=8) == 1  # of other buckets
    assert store.delete(spark, where, gone) == 1
    before = store.manifest(spark, where)

    monkeypatch.setattr(store, "swap", lambda *_: (_ for _ in ()).throw(RuntimeError("broken off")))
    with pytest.raises(RuntimeError):
        store.compact(spark, where)
    assert store.manifest(spark, where) == before and ranks(store.search(spark, where, asked, 7)) == want
    monkeypatch.undo()

    assert store.compact(spark, where) == 3 and len(store.manifest(spark, where)) == 1
    assert ranks(store.search(spark, where, asked, 7)) == want and store.is_current(left, where)
    assert store.compact(spark, where) == 0
    assert store.read(spark, where, "docs", before).count() == 59  # a reader of the older version still has its tables
    assert store.rebuild(docs, where) == 62
    assert ranks(store.search(spark, where, asked, 7)) == ranks(index.bm25(docs, asked, 7))
    with pytest.raises(ValueError):
        store.rebuild(docs.limit(0), where)
    assert store.is_current(docs, where)


def test_all_deleted_and_odd_rows(spark, tmp_path, asked):
    where = str(tmp_path)
    assert store.search(spark, where, asked, 3).count() == 0 and store.delete(spark, where, spark.createDataFrame([(1,)], "doc long")) == 0
    rows = [(1, "alpha beta"), (1, "alpha"), (1, "alpha"), (None, "alpha"), (2, None)]
    assert store.fill(table(spark, rows), where) == 2
    dl = {r.doc: r.dl for r in store.read(spark, where, "docs").collect()}
    assert dl[2] == 0 and {r.dl for r in store.read(spark, where, "postings").filter("doc = 1").collect()} == {dl[1]}
    assert store.delete(spark, where, spark.createDataFrame([(1,), (2,)], "doc long")) == 2
    assert store.compact(spark, where) == 1 and store.manifest(spark, where) == []
    assert store.fill(table(spark, rows), where) == 2


def test_a_frequent_term_lies_in_several_files(spark, tmp_path):
    where, key = str(tmp_path), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")  # partitions as small as these would be joined
    store.fill(spark.range(4000).selectExpr("id AS doc_id", "concat('common w', id) AS text"), where)
    spark.conf.unset(key)
    own = store.read(spark, where, "postings").filter("term = 'common'").selectExpr("input_file_name() AS f").distinct()
    assert own.count() > 1


def test_postings_are_held_for_some_documents_at_a_time():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array([["a", "b", "a"]] * 1000)], names=["doc", "w"])
    parts = list(store.by_term(iter([batch])))
    assert max(p.num_rows for p in parts) <= 2 * 256 and sum(p.num_rows for p in parts) == 2000
