"""Queries: the stateful ingest of files that Spark writes from the benchmark's items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import store
from lectern.operators.scratch import scratch_path
from lectern.plans.registry import query, table
from lectern.streaming import corpus


def two_runs(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """A file for each item, the even ones there in the first of two runs; (where the state is, the registry)."""
    root, where = scratch_path(spark, "files"), scratch_path(spark, "ingest")
    items = table(spark, sf_dir, "benchmark").filter("text IS NOT NULL")
    for run in (1, 2):
        items.filter(F.col("item_id") % 2 == run - 1).select("item_id", "text").write.mode("append").partitionBy("item_id").text(root)
        corpus.ingest(spark, root, where, run)
    return where, corpus.registry(spark, where)


@query("SELECT item_id, substr(sha256(text || chr(10)), 1, 16) AS doc_hash, 'added' AS action, item_id % 2 + 1 AS run FROM benchmark WHERE text IS NOT NULL")
def ingest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows = two_runs(spark, sf_dir)
    return rows.select(F.regexp_extract("path", "item_id=(-?\\d+)", 1).cast("long").alias("item_id"), "doc_hash", "action", "run")


@query("SELECT ('0x' || substr(sha256(text || chr(10)), 1, 15))::BIGINT AS doc FROM benchmark WHERE text IS NOT NULL GROUP BY 1")
def ingested_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the index holds after both runs."""
    where, _ = two_runs(spark, sf_dir)
    return store.read(spark, f"{where}/index", "docs").select("doc")
