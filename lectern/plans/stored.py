"""Queries: stored chunks, which are the lines of the documents, with vectors of the given table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import doc_hash
from lectern.operators import chunk_store
from lectern.operators.scratch import scratch_path
from lectern.plans.corpus import HASH_SQL
from lectern.plans.registry import query, table, texts

LINES_SQL = f"lines AS (SELECT doc_id, {HASH_SQL} AS doc_hash, i - 1 AS place, l[i] AS text FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), unnest(range(1, len(l) + 1)) AS u(i))"


def stored(spark: SparkSession, sf_dir: str) -> str:
    where = scratch_path(spark, "chunks")
    lines = texts(spark, sf_dir).filter("text IS NOT NULL").select("doc_id", doc_hash(F.col("text")).alias("doc_hash"), F.posexplode(F.split("text", "\n")).alias("place", "text"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    chunk_store.write(lines.join(vectors, "doc_id", "left").withColumn("page", F.col("place") % 3), where)
    return where


@query(f"WITH {LINES_SQL} SELECT doc_id, doc_hash, CAST(place AS INT) AS place, text FROM lines WHERE doc_hash IN (SELECT doc_hash FROM lines WHERE doc_id % 97 = 5)")
def chunks_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of a list of documents, and of those that equal them."""
    wanted = table(spark, sf_dir, "documents").filter("doc_id % 97 = 5 AND text IS NOT NULL").select(doc_hash(F.col("text")).alias("doc_hash"))
    return chunk_store.of_documents(spark, stored(spark, sf_dir), wanted).select("doc_id", "doc_hash", "place", "text")


@query(f"WITH {LINES_SQL} SELECT doc_hash, count(*) AS n_chunks, CAST(sum(length(text)) AS BIGINT) AS n_chars, count(DISTINCT place % 3) AS n_pages FROM lines GROUP BY doc_hash")
def stored_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_store.sizes(spark, stored(spark, sf_dir))


@query(f"WITH {LINES_SQL}, m AS (SELECT doc_hash, i - 1 AS dim, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM lines JOIN embeddings ON vec_id = doc_id, unnest(range(1, 65)) AS u(i) GROUP BY doc_hash, i) SELECT doc_hash, CAST(dim AS INT) AS dim, round(x, 6) AS x FROM m")
def stored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = chunk_store.document_vectors(spark, stored(spark, sf_dir), 64)
    return means.select("doc_hash", F.posexplode("v").alias("dim", "x")).select("doc_hash", "dim", F.round("x", 6).alias("x"))
