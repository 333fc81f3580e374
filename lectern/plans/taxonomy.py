"""Queries: a taxonomy of nations, regions and blocs, with customers as documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import taxonomy
from lectern.plans.registry import query, table

# Each nation is in its region and, if its key is even, in the even bloc: a diamond.
EDGES_SQL = """e AS (SELECT 'N' || n_nationkey AS child, 'r' || n_regionkey AS parent, CASE WHEN n_nationkey % 3 = 0 THEN 'proposed' ELSE 'curated' END AS origin FROM nation
UNION ALL SELECT 'N' || n_nationkey, 'even', 'curated' FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'r' || r_regionkey, 'world', 'curated' FROM region UNION ALL SELECT 'even', 'world', 'proposed'
), l AS (SELECT c_custkey AS doc, 'N' || c_nationkey AS field, CASE WHEN c_custkey % 4 = 0 THEN 'proposed' ELSE 'curated' END AS origin FROM customer WHERE c_custkey % 5 > 0), f AS (SELECT child AS field FROM e UNION SELECT parent FROM e UNION SELECT 'bare')"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    child = F.concat(F.lit("N"), k).alias("child")
    out = n.select(child, F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.when(k % 3 == 0, "proposed").otherwise("curated").alias("origin"))
    out = out.unionByName(n.filter(k % 2 == 0).select(child, F.lit("even").alias("parent"), F.lit("curated").alias("origin")))
    out = out.unionByName(table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("child"), F.lit("world").alias("parent"), F.lit("curated").alias("origin")))
    return out.unionByName(spark.createDataFrame([("even", "world", "proposed")], "child string, parent string, origin string"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").filter(k % 5 > 0).select(k.alias("doc"), F.concat(F.lit("N"), "c_nationkey").alias("field"), F.when(k % 4 == 0, "proposed").otherwise("curated").alias("origin"))


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return e.select(F.col("child").alias("field")).unionByName(e.select(F.col("parent").alias("field"))).unionByName(spark.createDataFrame([("bare",)], "field string")).distinct()


@query(f"""WITH RECURSIVE {EDGES_SQL}, up AS (SELECT child AS node, parent AS ancestor FROM e UNION SELECT node, parent FROM up JOIN e ON child = ancestor
), r AS (SELECT doc, field FROM l UNION SELECT doc, ancestor FROM l JOIN up ON node = field)
SELECT field, (SELECT count(DISTINCT parent) FROM e WHERE child = field) AS n_parents, (SELECT count(DISTINCT child) FROM e WHERE parent = field) AS n_children, (SELECT count(DISTINCT doc) FROM l WHERE l.field = f.field) AS n_direct,
  (SELECT count(DISTINCT doc) FROM l WHERE l.field = f.field AND origin = 'proposed') AS n_proposed, (SELECT count(DISTINCT doc) FROM r WHERE r.field = f.field) AS n_rolled_up, field NOT IN (SELECT child FROM e) AS is_root FROM f""")
def taxonomy_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.field_view(fields(spark, sf_dir), edges(spark, sf_dir), links(spark, sf_dir))


FRESH = [("world", "N1", "curated"), ("N3", "r1", "curated"), ("even", "world", "curated"), ("x", "y", "proposed"), ("y", "x", "proposed"), ("z", "z", "curated"), ("r0", "even", "proposed")]


def with_fresh(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return taxonomy.add_edges(edges(spark, sf_dir), spark.createDataFrame(FRESH, "child string, parent string, origin string"))


@query(f"""WITH {EDGES_SQL}, n AS (SELECT * FROM e WHERE child || parent NOT IN ('N3r1', 'evenworld') UNION ALL SELECT 'N3', 'r1', 'curated' UNION ALL SELECT 'even', 'world', 'curated' UNION ALL SELECT 'r0', 'even', 'proposed')
SELECT child, parent, min(origin) AS origin FROM n WHERE NOT (child = 'N5' AND parent LIKE 'r%') GROUP BY 1, 2""")
def taxonomy_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New edges are added or promoted, those of cycles rejected; then one is removed."""
    kept, _ = with_fresh(spark, sf_dir)
    return taxonomy.remove_edges(kept, kept.filter("child = 'N5' AND parent LIKE 'r%'"))


@query("SELECT * FROM (VALUES ('world', 'N1', 'cycle'), ('x', 'y', 'cycle'), ('y', 'x', 'cycle'), ('z', 'z', 'cycle')) AS t(child, parent, why)")
def taxonomy_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_fresh(spark, sf_dir)[1]


@query(f"""WITH {EDGES_SQL}, s AS (SELECT c_custkey AS doc, CASE WHEN c_custkey % 3 = 0 THEN 'even' ELSE 'N' || c_nationkey END AS field, 'curated' AS origin FROM customer WHERE c_custkey % 10 < 4
), a AS (SELECT doc, field, min(origin) AS origin FROM (SELECT * FROM l UNION ALL SELECT * FROM s) GROUP BY 1, 2) SELECT * FROM a WHERE NOT (field = 'even' AND doc % 2 = 0)""")
def placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    fresh = table(spark, sf_dir, "customer").filter(k % 10 < 4).select(k.alias("doc"), F.when(k % 3 == 0, "even").otherwise(F.concat(F.lit("N"), "c_nationkey")).alias("field"), F.lit("curated").alias("origin"))
    bad = fresh.limit(1).select("doc", F.lit("no such field").alias("field"), "origin")
    both = taxonomy.attach(links(spark, sf_dir), fresh.unionByName(bad), fields(spark, sf_dir))
    return taxonomy.detach(both, both.filter("field = 'even' AND doc % 2 = 0"))


@query(f"WITH {EDGES_SQL} SELECT c_custkey AS doc FROM customer WHERE c_custkey NOT IN (SELECT doc FROM l)")
def unclassified_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.unplaced(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc")), links(spark, sf_dir), "doc")


@query(f"WITH {EDGES_SQL} SELECT field FROM f WHERE field NOT IN (SELECT child FROM e)")
def unplaced_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.unplaced(fields(spark, sf_dir), edges(spark, sf_dir).select(F.col("child").alias("field")), "field")


@query(f"WITH {EDGES_SQL} SELECT DISTINCT child AS field, lower(child) AS sort_key FROM e WHERE parent = 'even'")
def group_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.candidates(taxonomy.narrower(edges(spark, sf_dir), "even"))


@query(f"""WITH {EDGES_SQL}, s AS (SELECT c_custkey AS doc, CASE c_custkey % 3 WHEN 0 THEN 'even' WHEN 1 THEN 'nowhere' ELSE 'N' || c_nationkey END AS field FROM customer)
SELECT s.doc, s.field, CASE WHEN s.field = 'nowhere' THEN 'rejected' WHEN l.doc IS NOT NULL THEN 'known' ELSE 'written' END AS outcome FROM s LEFT JOIN l ON l.doc = s.doc AND l.field = s.field""")
def placement_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 3
    suggested = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), F.when(k == 0, "even").when(k == 1, "nowhere").otherwise(F.concat(F.lit("N"), "c_nationkey")).alias("field"))
    return taxonomy.proposals(links(spark, sf_dir), suggested, fields(spark, sf_dir))
