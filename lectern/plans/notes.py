"""Query: runs of topic notes over clusters of documents, of which some change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import doc_hash
from lectern.operators import notes
from lectern.operators.scratch import materialize, scratch_path
from lectern.plans.registry import query, table


@query("""WITH c AS (SELECT doc_id, doc_id % 12 AS cluster, doc_id % 12 <> 3 AND doc_id % 24 <> 4 AS early FROM documents), k AS (SELECT cluster, bool_or(early) AS before, bool_or(NOT early) AS more FROM c GROUP BY cluster)
SELECT 1 AS run, 'added' AS action, count(*) FILTER (before) AS n FROM k
UNION ALL SELECT 2, 'added', count(*) FILTER (more) FROM k HAVING count(*) FILTER (more) > 0
UNION ALL SELECT 2, 'removed', count(*) FILTER (more AND before) FROM k HAVING count(*) FILTER (more AND before) > 0""")
def topic_note_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First without one cluster and half of another, then whole, then again: the last run writes nothing."""
    where = scratch_path(spark, "notes")
    docs = table(spark, sf_dir, "documents")
    every = materialize(docs.select(F.col("doc_id").alias("doc"), doc_hash(F.concat_ws("|", "doc_id", "text")).alias("doc_hash"), F.concat(F.lit("Text "), "doc_id").alias("title"), "lang"), "hashed")
    edges = every.select(F.col("doc").alias("a"), (F.col("doc") + 12).alias("b"))  # within clusters only
    for run in (1, 2, 3):
        own = every.filter("doc % 12 <> 3 AND doc % 24 <> 4") if run == 1 else every
        notes.refresh(notes.assemble(own.select((F.col("doc") % 12).alias("cluster"), "doc"), own, own.select("doc", F.col("lang").alias("keyword")).na.drop(), edges), where, run)
    return notes.stored(spark, where).groupBy(F.col("run").cast("int").alias("run"), "action").agg(F.count("*").alias("n"))
