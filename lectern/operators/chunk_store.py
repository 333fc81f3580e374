"""Stored chunks with their vectors, partitioned by a hash of their document, so that a list of documents reads only its own buckets.

Within a bucket chunks are sorted by document, so page statistics skip what is not asked for. Chunks
without document hash are not stored; repeated rows are stored each; a chunk may have no text or vector.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.scratch import join_sized, materialize
from lectern.operators.vector_index import pooled

BUCKETS = 64
#: So many documents are asked for by name, and reach the scan as a filter; more are joined.
NAMED = 1000


def bucket_of(doc_hash: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(doc_hash), F.lit(buckets)).cast("int")


def write(chunks: DataFrame, where: str, buckets: int = BUCKETS) -> None:
    """Store ``chunks`` (doc_hash, place and others). Ranges of bucket, document and place are written by a task each, so a long document may lie in several files."""
    placed = chunks.filter("doc_hash IS NOT NULL").withColumn("bucket", bucket_of(F.col("doc_hash"), buckets))
    ranged = placed.repartitionByRange("bucket", "doc_hash", "place").sortWithinPartitions("bucket", "doc_hash", "place")
    ranged.write.partitionBy("bucket").parquet(where)


def every(spark: SparkSession, where: str) -> DataFrame:
    return spark.read.parquet(where).drop("bucket")


def of_documents(spark: SparkSession, where: str, wanted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The chunks of the documents in ``wanted`` (doc_hash).

    A short list becomes a filter on buckets and hashes, which the scan uses itself; of a long one all buckets
    are read, and hot documents are joined by broadcast.
    """
    hashes = wanted.select("doc_hash").filter("doc_hash IS NOT NULL").distinct().withColumn("bucket", bucket_of(F.col("doc_hash"), buckets))
    asked = hashes.limit(NAMED + 1).collect()
    stored = spark.read.parquet(where)
    if len(asked) <= NAMED:
        numbers, names = sorted({r.bucket for r in asked}), sorted(r.doc_hash for r in asked)
        return stored.filter(F.col("bucket").isin(*numbers) & F.col("doc_hash").isin(*names) if names else F.lit(False)).drop("bucket")
    sized = materialize(stored.groupBy("doc_hash").agg(F.count("*").alias("_n")).join(hashes.select("doc_hash"), "doc_hash"), "wanted")
    return join_sized(stored, sized, ["doc_hash"], "_n").drop("bucket", "_n")


def sizes(spark: SparkSession, where: str) -> DataFrame:
    """doc_hash, n_chunks, n_chars, n_pages of every document; only these columns are read."""
    n_pages = F.count_distinct("page") if "page" in spark.read.parquet(where).columns else F.lit(0)
    return every(spark, where).groupBy("doc_hash").agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"), n_pages.cast("long").alias("n_pages"))


def document_vectors(spark: SparkSession, where: str, dim: int) -> DataFrame:
    """doc_hash, v: the mean of each document's chunk vectors; those without any have no row."""
    return pooled(every(spark, where).filter("vector IS NOT NULL").select("doc_hash", "vector"), "doc_hash", "vector", dim)
