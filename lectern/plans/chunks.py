"""Queries: chunks of the documents, and the stored index over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import chunking, store
from lectern.operators.scratch import materialize, scratch_path
from lectern.plans.registry import query, table, texts
from lectern.plans.search import bm25_sql


def children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(chunking.parent_child(texts(spark, sf_dir)), "children")


@query()
def chunk_parent_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    return children(spark, sf_dir)


@query()
def chunk_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.parents(children(spark, sf_dir))


@query()
def chunk_baseline_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.health_signals(chunking.baseline(texts(spark, sf_dir)))


@query()
def chunk_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.sample(children(spark, sf_dir))


@query("""WITH f AS (SELECT page_id AS figure, CASE WHEN page_id % 3 > 0 THEN 'Figure ' || page_id || ': ' || url END AS c, CASE WHEN page_id % 4 > 0 THEN 'shows ' || page_id END AS d, CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE 'around ' || page_id END AS x FROM pages), t AS (SELECT figure, concat_ws(chr(10), c, d) AS text, x FROM f)
SELECT figure, text, CASE WHEN trim(x) <> '' THEN text || chr(10) || chr(10) || '---' || chr(10) || chr(10) || trim(x) ELSE text END AS parent_text FROM t WHERE text <> ''""")
def figure_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    around = F.when(k % 5 == 0, None).when(k % 5 == 1, "  ").otherwise(F.concat(F.lit("around "), k))
    figures = table(spark, sf_dir, "pages").select(k.alias("figure"), F.when(k % 3 > 0, F.concat(F.lit("Figure "), k, F.lit(": "), "url")).alias("caption"), F.when(k % 4 > 0, F.concat(F.lit("shows "), k)).alias("description"), around.alias("context"))
    return chunking.figure_chunks(figures)


@query(bm25_sql(10))
def bm25_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index filled in two steps, the second of which overlaps the first, ranks as one."""
    where, docs = scratch_path(spark, "index"), texts(spark, sf_dir)
    store.fill(docs.filter("doc_id % 3 = 0"), where)
    store.fill(docs, where)
    return store.search(spark, where, table(spark, sf_dir, "benchmark"), 10)


@query("SELECT count(*) FILTER (doc_id % 3 = 0) AS first, count(*) FILTER (doc_id % 3 <> 0) AS second, 0 AS third, FALSE AS current_before, TRUE AS current_after FROM documents")
def index_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    where, docs = scratch_path(spark, "index"), texts(spark, sf_dir)
    first, before = store.fill(docs.filter("doc_id % 3 = 0"), where), store.is_current(docs, where)
    row = (first, store.fill(docs, where), store.fill(docs, where), before, store.is_current(docs, where))
    return spark.createDataFrame([row], "first long, second long, third long, current_before boolean, current_after boolean")


LEFT_SQL = bm25_sql(10).replace("FROM documents", "FROM (SELECT * FROM documents WHERE doc_id % 7 <> 1)")


@query(LEFT_SQL)
def bm25_after_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of which every seventh document is deleted, and one of these filled in and deleted again, ranks what is left; compaction changes nothing."""
    where, docs = scratch_path(spark, "index"), texts(spark, sf_dir)
    gone = docs.filter("doc_id % 7 = 1")
    store.fill(docs.filter("doc_id % 3 = 0"), where)
    store.delete(spark, where, gone.select(F.col("doc_id").alias("doc")))
    store.fill(docs, where)
    store.delete(spark, where, gone.select(F.col("doc_id").alias("doc")))
    store.compact(spark, where)
    return store.search(spark, where, table(spark, sf_dir, "benchmark"), 10)


@query("""SELECT count(*) FILTER (doc_id % 3 = 0) AS filled, count(*) FILTER (doc_id % 3 = 0 AND doc_id % 7 = 1) AS deleted, 0 AS deleted_again, count(*) FILTER (doc_id % 3 <> 0 OR doc_id % 7 = 1) AS refilled, 2 AS compacted, 1 AS segments, TRUE AS current FROM documents""")
def index_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    where, docs = scratch_path(spark, "index"), texts(spark, sf_dir)
    gone = docs.filter("doc_id % 7 = 1").select(F.col("doc_id").alias("doc"))
    row = [store.fill(docs.filter("doc_id % 3 = 0"), where), store.delete(spark, where, gone), store.delete(spark, where, gone), store.fill(docs, where), store.compact(spark, where)]
    row += [len(store.manifest(spark, where)), store.is_current(docs, where)]
    return spark.createDataFrame([tuple(row)], "filled long, deleted long, deleted_again long, refilled long, compacted long, segments long, current boolean")
