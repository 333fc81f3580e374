"""Queries: the ingest registry and source manifests, over files that are derived from the pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import registry
from lectern.plans.registry import query, table

# In SQL that Spark and the oracle read alike.
PATH = "'dir' || page_id % 9 || '/f' || page_id || '.' || CASE page_id % 6 WHEN 0 THEN 'PDF' WHEN 1 THEN 'md' WHEN 2 THEN 'doc' WHEN 3 THEN 'html' WHEN 4 THEN 'xyz' ELSE 'txt' END"
GOOD = "('pdf', 'epub', 'html', 'htm', 'docx', 'odt', 'rtf', 'md', 'txt')"
FILES = f"f AS (SELECT page_id, {PATH} AS rel_path, page_id * 17 % 1000 AS size, page_id % 50 AS mtime, 's' || page_id % 400 AS sha, lower(regexp_extract({PATH}, '\\.([^./]+)$', 1)) AS ext FROM pages)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = "page_id"
    return table(spark, sf_dir, "pages").select(k, F.expr(PATH).alias("rel_path"), F.expr("page_id * 17 % 1000").alias("size"), F.expr("page_id % 50").alias("mtime"), F.expr("'s' || page_id % 400").alias("sha"))


@query(f"WITH {FILES} SELECT rel_path, ext IN {GOOD} AS supported, CASE WHEN ext IN {GOOD} THEN NULL WHEN ext = 'doc' THEN 'convert to docx' ELSE 'unsupported' END AS advice FROM f")
def file_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("rel_path")
    return files(spark, sf_dir).select("rel_path", registry.is_supported(path).alias("supported"), registry.format_advice(path).alias("advice"))


ASKED = ["dir0/f0.PDF", " ./dir1\\f1.md", "/etc/x.md", "C:/x.md", "a/../b.md", "..", "dir2/f2.doc", "gone.md", "dir1/f1.md", "./././dir3/f3.html"]


@query("""SELECT * FROM (VALUES ('dir0/f0.PDF', 'valid'), ('dir1/f1.md', 'valid'), ('/etc/x.md', 'absolute'), ('C:/x.md', 'absolute'), ('a/../b.md', 'traversal'), ('..', 'traversal'), ('dir2/f2.doc', 'unsupported'), ('gone.md', 'unknown'), ('dir3/f3.html', 'valid')) AS t(path, verdict)""")
def selection_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.validate_selection(spark.createDataFrame([(p,) for p in ASKED], "path string"), files(spark, sf_dir))


SCAN_SQL = f"""{FILES}, r AS (SELECT rel_path, page_id % 5 = 0 AS excluded FROM f WHERE page_id % 2 = 0 UNION ALL SELECT 'gone/' || page_id || '.md', FALSE FROM f WHERE page_id % 20 = 0
), s AS (SELECT coalesce(g.rel_path, r.rel_path) AS rel_path, g.size, coalesce(excluded, FALSE) AS excluded, CASE WHEN g.page_id IS NULL THEN 'missing' WHEN g.page_id % 3 = 0 THEN 'new' WHEN g.page_id % 7 < 4 THEN 'ingested' ELSE 'changed' END AS status
  FROM (SELECT * FROM f WHERE ext IN {GOOD}) g FULL JOIN r ON g.rel_path = r.rel_path)"""


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    rows = f.filter("page_id % 2 = 0").select("rel_path", (F.col("page_id") % 5 == 0).alias("excluded"))
    gone = f.filter("page_id % 20 = 0").select(F.concat(F.lit("gone/"), "page_id", F.lit(".md")).alias("rel_path"), F.lit(False).alias("excluded"))
    return registry.scan(f, rows.unionByName(gone), f.filter("page_id % 3 <> 0"), f.filter("page_id % 7 < 4"))


# A file that is registered but cannot be read is missing to the scan.
@query(f"WITH {SCAN_SQL} SELECT * FROM s")
def source_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(spark, sf_dir)


ACTION = "CASE WHEN {0} THEN 'excluded' WHEN status = 'new' THEN 'would_add' WHEN status = 'changed' THEN 'would_reembed' ELSE 'skip_unchanged' END"


@query(f"WITH {SCAN_SQL} SELECT 'all' AS selection, {ACTION.format('excluded')} AS action, count(*) AS n FROM s WHERE status <> 'missing' GROUP BY 2 UNION ALL SELECT 'asked', {ACTION.format('FALSE')}, count(*) FROM s WHERE status <> 'missing' AND starts_with(rel_path, 'dir1/') GROUP BY 2")
def ingest_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scanned(spark, sf_dir)
    asked = rows.filter(F.startswith("rel_path", F.lit("dir1/"))).select(F.col("rel_path").alias("path"))
    return registry.plan(rows).withColumn("selection", F.lit("all")).unionByName(registry.plan(rows, asked).withColumn("selection", F.lit("asked")))


@query(f"WITH {FILES} SELECT rel_path, page_id % 3 = 0 OR page_id % 10 = 1 AS excluded FROM f")
def exclude_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    rows = f.select("rel_path", (F.col("page_id") % 3 == 0).alias("excluded"))
    return registry.set_excluded(rows, f.filter("page_id % 10 = 1").select("rel_path").unionByName(spark.createDataFrame([("none",)], "rel_path string")), True)


@query(f"WITH {FILES} SELECT rel_path, CASE WHEN page_id % 4 = 0 THEN 'no_cache' WHEN 25 < mtime THEN 'source_changed' WHEN page_id % 3 = 0 THEN 'extractor_changed' END AS reason FROM f")
def stale_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    cache = f.filter("page_id % 4 <> 0").select("rel_path", F.lit(25).alias("c_mtime"), F.when(F.col("page_id") % 3 == 0, F.lit(None).cast("string")).otherwise("v2").alias("c_fingerprint"))
    return registry.stale_reason(f, cache, "v2")


@query(f"""WITH {FILES} SELECT 'h' || page_id AS doc_hash, CASE WHEN page_id % 4 = 2 THEN 'stale' ELSE 'gone' END AS why FROM f WHERE page_id % 4 IN (2, 3)""")
def rebuild_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of four rows one is reproduced, one failed, one has a new hash, one lost its source."""
    f = files(spark, sf_dir).withColumn("doc_hash", F.concat(F.lit("h"), "page_id"))
    k = F.col("page_id") % 4
    made = f.filter(k == 0).unionByName(f.filter(k == 2).withColumn("doc_hash", F.concat(F.lit("new"), "page_id")))
    return registry.rebuild_sweep(f, made, f.filter(k != 3))


@query(f"""WITH {FILES}, o AS (SELECT rel_path AS filename, CASE WHEN page_id % 2 = 0 THEN 'u' || page_id END AS url, 'old' AS sha, 1 AS size FROM f WHERE page_id % 3 <> 0), n AS (SELECT rel_path AS filename, sha, size FROM f WHERE page_id % 5 <> 0
), m AS (SELECT coalesce(o.filename, n.filename) AS filename, url, coalesce(n.sha, o.sha) AS sha, coalesce(n.size, o.size) AS size FROM o FULL JOIN n ON o.filename = n.filename)
SELECT filename, coalesce(url, CASE WHEN sha = 's7' THEN 'by-sha' END, CASE WHEN starts_with(filename, 'dir3/') THEN 'by-name' END) AS url, sha, CAST(size AS BIGINT) AS size FROM m""")
def manifest_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).withColumn("filename", F.col("rel_path"))
    stored = f.filter("page_id % 3 <> 0").select("filename", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("u"), "page_id")).alias("url"), F.lit("old").alias("sha"), F.lit(1).cast("long").alias("size"))
    public = f.filter(F.startswith("filename", F.lit("dir3/"))).select("filename", F.lit("by-name").alias("url"), F.lit("none").alias("sha"))
    public = public.unionByName(spark.createDataFrame([("other", "by-sha", "s7")], "filename string, url string, sha string"))
    return registry.enrich_urls(registry.merge_manifest(stored, f.filter("page_id % 5 <> 0")), public)


@query(f"WITH {FILES} SELECT rel_path AS filename, CASE WHEN page_id % 5 = 0 THEN CASE WHEN page_id % 2 = 0 THEN 'no_url' ELSE 'would_download' END WHEN page_id % 7 = 0 OR page_id % 3 <> 0 THEN 'present' ELSE 'mismatch' END AS outcome FROM f")
def manifest_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, k = files(spark, sf_dir), F.col("page_id")
    entries = f.select(F.col("rel_path").alias("filename"), F.when(k % 2 != 0, "url").alias("url"), F.when(k % 7 != 0, F.col("sha")).alias("sha"))
    found = f.filter("page_id % 5 <> 0").select(F.col("rel_path").alias("filename"), F.when(k % 3 == 0, "bad").otherwise(F.col("sha")).alias("sha"))
    return registry.verify_manifest(entries, found)


@query(f"""WITH {FILES}, d AS (SELECT rel_path AS filename, count(*) AS n FROM f, (SELECT unnest([1, 2]) AS c) WHERE page_id % 4 = 1 OR (page_id % 4 = 2 AND c = 1) GROUP BY 1)
SELECT rel_path AS filename, coalesce(n, 0) AS n_docs, coalesce(n, 0) > 1 AS ambiguous FROM f LEFT JOIN d ON filename = rel_path WHERE page_id % 3 = 0""")
def pinned_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).withColumn("sha", F.concat("sha", F.lit("-"), "page_id")).withColumn("filename", F.col("rel_path"))
    once, twice = f.filter("page_id % 4 IN (1, 2)"), f.filter("page_id % 4 = 1")
    return registry.match_pins(f.filter("page_id % 3 = 0"), f, once.unionByName(twice))


# Versions of the documents' numbers: with and without v and a third part, and some that are none.
CANDIDATE = "CASE doc_id % 5 WHEN 0 THEN 'v' || doc_id % 3 || '.' || doc_id % 12 || '.' || doc_id % 7 WHEN 1 THEN doc_id % 3 || '.' || doc_id % 12 WHEN 2 THEN '1.' || doc_id WHEN 3 THEN 'x' || doc_id ELSE doc_id % 3 || '.10.' || doc_id % 11 END"
CURRENT = "CASE WHEN doc_id % 7 = 3 THEN 'none' WHEN doc_id % 2 = 0 THEN doc_id % 4 || '.9' ELSE 'v1.' || doc_id % 13 || '.' || doc_id % 4 END"


@query(f"""WITH v AS (SELECT doc_id, {CANDIDATE} AS a, {CURRENT} AS b FROM documents), n AS (
  SELECT *, list_transform(string_split(ltrim(a, 'v'), '.'), lambda x: TRY_CAST(x AS INT)) AS x, list_transform(string_split(ltrim(b, 'v'), '.'), lambda y: TRY_CAST(y AS INT)) AS y FROM v)
SELECT doc_id, a, b, CASE WHEN doc_id % 5 = 3 OR doc_id % 7 = 3 THEN FALSE ELSE (x[1], x[2], coalesce(x[3], 0)) > (y[1], y[2], coalesce(y[3], 0)) END AS newer FROM n""")
def version_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(CANDIDATE).alias("a"), F.expr(CURRENT).alias("b"))
    return rows.withColumn("newer", registry.newer_version(F.col("a"), F.col("b")))
