"""Query: a table of documents that gains a column, rows, and a new shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.operators import versions
from lectern.operators.scratch import scratch_path
from lectern.plans.registry import query, table


@query("""WITH v AS (SELECT doc_id, source, lang, doc_id % 2 AS part FROM documents)
SELECT 1 AS version, count(*) AS n, count(DISTINCT source) AS sources, CAST(NULL AS BIGINT) AS kinds FROM v WHERE part = 0
UNION ALL SELECT 2, count(*), count(DISTINCT source), count(*) FROM v WHERE part = 0
UNION ALL SELECT 3, count(*), count(DISTINCT source), count(*) - count(*) FILTER (part = 1 AND source IS NULL) FROM v
UNION ALL SELECT 4, count(*), NULL, count(*) - count(*) FILTER (part = 1 AND source IS NULL) FROM v WHERE doc_id IN (SELECT doc_id FROM labels)""")
def table_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What readers of each version see: half of the rows; a column with a default; all rows; those with a label, without their source."""
    where, docs = scratch_path(spark, "table"), table(spark, sf_dir, "documents")
    versions.create(docs.filter("doc_id % 2 = 0").select("doc_id", "source"), where)
    versions.add_columns(spark, where, [("kind", "string", "'paper'"), ("source", "string", None)])
    versions.append(docs.filter("doc_id % 2 = 1").select("doc_id", "source", F.col("source").alias("kind")), where)
    shape = StructType.fromDDL("doc_id long, kind string, note string")
    versions.rebuild(spark, where, shape, references=("doc_id", table(spark, sf_dir, "labels")))
    out = None
    for version in range(1, 5):
        rows = versions.read(spark, where, version)
        sources, kinds = (F.count_distinct("source") if "source" in rows.columns else F.lit(None).cast("long")), (F.count("kind") if "kind" in rows.columns else F.lit(None).cast("long"))
        seen = rows.agg(F.count("*").alias("n"), sources.alias("sources"), kinds.alias("kinds")).select(F.lit(version).alias("version"), "n", "sources", "kinds")
        out = seen if out is None else out.unionByName(seen)
    return out
