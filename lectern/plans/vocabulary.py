"""Queries: the curated vocabulary over keyword links that are derived from the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import vocabulary as V
from lectern.plans.library import LIB, lib
from lectern.plans.registry import query

CONCEPTS = [("Tongue", ["en", "DE"], True, "concept"), ("src1", ["Src2", "src1"], None, "concept"), ("Field", [], False, "domain"), ("Ada Bell", ["ada"], False, "concept")]
CONCEPTS_SQL = "c AS (SELECT * FROM (VALUES " + ", ".join(f"('{x}', CAST({a!r} AS VARCHAR[]), {'NULL' if g is None else g}, '{k}')" for x, a, g, k in CONCEPTS) + ") AS t(label, aliases, graph_include, kind)), names AS (SELECT DISTINCT lower(unnest(list_append(aliases, label))) AS k, label, graph_include FROM c)"
LINKS = f"{LIB}, l AS (SELECT doc_id AS doc, source AS name, 'extracted' AS source FROM lib WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, lang, 'manual' FROM lib UNION ALL SELECT doc_id, 'Bell Ada', 'extracted' FROM lib WHERE doc_id % 50 = 1)"


def concepts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONCEPTS, "label string, aliases array<string>, graph_include boolean, kind string")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lib(spark, sf_dir)
    parts = [docs.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("doc"), F.col("source").alias("name"), F.lit("extracted").alias("source"))]
    parts.append(docs.select(F.col("doc_id").alias("doc"), F.col("lang").alias("name"), F.lit("manual").alias("source")))
    parts.append(docs.filter("doc_id % 50 = 1").select(F.col("doc_id").alias("doc"), F.lit("Bell Ada").alias("name"), F.lit("extracted").alias("source")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""WITH {LINKS}, x AS (SELECT doc_id AS doc, unnest([lang, 'new']) AS name FROM lib WHERE doc_id % 3 = 0)
SELECT * FROM l UNION ALL SELECT doc, name, 'extracted' FROM x WHERE doc NOT IN (SELECT doc FROM l WHERE source = 'extracted') AND name = 'new'""")
def persist_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lib(spark, sf_dir).filter("doc_id % 3 = 0").select(F.col("doc_id").alias("doc"), F.explode(F.array("lang", F.lit("new"))).alias("name"))
    return V.persist_keywords(links(spark, sf_dir), found)


@query(f"WITH {LIB} SELECT doc_id AS doc, CASE WHEN doc_id % 6 = 0 THEN 'fresh' ELSE 'stored' END AS state FROM lib WHERE doc_id % 2 = 0 OR doc_id % 6 = 0")
def forced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lib(spark, sf_dir).select(F.col("doc_id").alias("doc"))
    stored, fresh = docs.filter("doc % 2 = 0").withColumn("state", F.lit("stored")), docs.filter("doc % 6 = 0").withColumn("state", F.lit("fresh"))
    return V.write_once(stored, fresh, "doc", force=True)


@query(f"""WITH {LINKS}, {CONCEPTS_SQL}, k AS (SELECT DISTINCT name, 'extracted' AS source FROM l UNION ALL SELECT 'orphan-' || doc_id % 5, CASE WHEN doc_id % 5 = 0 THEN 'manual' ELSE 'extracted' END FROM lib UNION ALL SELECT 'SRC2', 'extracted')
SELECT DISTINCT name FROM k WHERE source = 'extracted' AND name NOT IN (SELECT name FROM l) AND lower(name) NOT IN (SELECT k FROM names)""")
def orphan_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = links(spark, sf_dir)
    loose = lib(spark, sf_dir).select(F.concat(F.lit("orphan-"), F.col("doc_id") % 5).alias("name"), F.when(F.col("doc_id") % 5 == 0, "manual").otherwise("extracted").alias("source"))
    known = own.select("name", F.lit("extracted").alias("source")).unionByName(loose).unionByName(spark.createDataFrame([("SRC2", "extracted")], "name string, source string"))
    return V.orphan_keywords(known, own, concepts(spark)).distinct()


@query(f"""WITH {LINKS}, {CONCEPTS_SQL} SELECT name, count(DISTINCT doc) AS n_docs, lower(name) IN (SELECT k FROM names) AS promoted, lower(name) IN (SELECT k FROM names WHERE graph_include) AS in_graph, name = 'Bell Ada' AS is_person FROM l GROUP BY name""")
def keyword_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = V.name_bigrams(lib(spark, sf_dir).select("authors"))
    return V.candidates(links(spark, sf_dir), concepts(spark), people)


@query("SELECT * FROM (VALUES ('Tongue', 'DE,en,fr', TRUE, 'concept'), ('Topic', '', FALSE, 'concept'), ('Field', '', FALSE, 'domain'), ('Fresh', 'new', TRUE, 'concept')) AS t(label, aliases, graph_include, kind)")
def edited_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts are added to, flagged, relabelled, stripped of aliases and removed."""
    fresh = spark.createDataFrame([(" tongue ", ["fr", "en"]), ("Fresh", ["new"]), ("fresh", []), ("  ", ["x"])], "label string, aliases array<string>")
    out = V.add_concepts(concepts(spark), fresh)
    out = V.rename_concept(V.rename_concept(out, "src1", "FIELD"), "src1", "Topic")
    out = V.remove_alias(V.remove_alias(out, "Topic", "SRC1"), "Topic", "src2")
    out = V.remove_concepts(V.set_graph_include(out, ["Topic"], False), ["Ada Bell"])
    return out.withColumn("aliases", F.array_join("aliases", ","))


@query("SELECT * FROM (VALUES ('Tongue', TRUE), ('src1', TRUE), ('Field', FALSE), ('Ada Bell', FALSE)) AS t(label, graph_include)")
def graph_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.backfill_graph_include(concepts(spark).withColumn("source", F.when(F.col("label") == "src1", "manual").otherwise("found"))).select("label", "graph_include")


@query(f"""WITH {LIB} SELECT doc_id, 'plain' AS mode, coalesce(title, 'T' || doc_id) AS title, coalesce(year, CASE WHEN doc_id % 2 = 0 THEN 1999 END) AS year FROM lib
UNION ALL SELECT doc_id, 'forced', 'T' || doc_id, CASE WHEN doc_id % 2 = 0 THEN 1999 ELSE year END FROM lib""")
def filled_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lib(spark, sf_dir).select("doc_id", "title", "year")
    found = docs.select("doc_id", F.concat(F.lit("T"), "doc_id").alias("title"), F.when(F.col("doc_id") % 2 == 0, 1999).alias("year"))
    plain, forced = (V.fill_metadata(docs, found, "doc_id", ["title", "year"], force).withColumn("mode", F.lit(m)) for m, force in (("plain", False), ("forced", True)))
    return plain.unionByName(forced)


@query(f"WITH {LIB} SELECT doc_id AS key, CASE WHEN doc_id % 3 = 0 THEN 'added' ELSE 'removed' END AS change FROM lib WHERE (doc_id % 2 = 0) <> (doc_id % 3 = 0)")
def manifest_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = lib(spark, sf_dir).select(F.col("doc_id").alias("key"))
    return V.diff_manifests(keys.filter("key % 2 = 0"), keys.filter("key % 3 = 0"))


@query(f"WITH {CONCEPTS_SQL} SELECT label, array_to_string(list_sort(list_filter(aliases, lambda a: lower(a) <> lower(label))), ',') AS aliases, lower(label) AS sort_key, coalesce(graph_include, FALSE) AS in_graph FROM c WHERE kind = 'concept'")
def glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = concepts(spark)
    included = V.graph_vocabulary(own).select("label", F.lit(True).alias("in_graph"))
    return V.glossary(own).join(included, "label", "left").withColumn("in_graph", F.coalesce("in_graph", F.lit(False)))
