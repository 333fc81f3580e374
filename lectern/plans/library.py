"""Queries: reads and edits of the document library, over a library that is derived from the given documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import catalog
from lectern.plans.registry import query, table

# The library's columns, in SQL that Spark and the oracle read alike.
COLUMNS = {
    "doc_id": "doc_id",
    "doc_hash": "substr('h' || (doc_id * 7919 % 1000003) || 'x' || doc_id, 1, 16)",
    "format": "CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'epub' WHEN 2 THEN 'md' WHEN 3 THEN 'html' ELSE 'docx' END",
    "filename": "'paper-' || doc_id || '.' || CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'epub' WHEN 2 THEN 'md' WHEN 3 THEN 'html' ELSE 'docx' END",
    "health": "CASE doc_id % 7 WHEN 1 THEN 'broken' WHEN 2 THEN 'marginal' WHEN 0 THEN NULL ELSE 'healthy' END",
    "title": "CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE 'On ' || source || ' and ' || lang || ' ' || doc_id % 100 END",
    "authors": "CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Ada Bell' WHEN 2 THEN 'Carl Dorn; Eve Frey & Gus Hall' ELSE 'Ida Jung, Kim Lund and Max Nolte, Ole Petri' END",
    "year": "CASE WHEN doc_id % 9 = 0 THEN NULL ELSE CAST(1950 + doc_id % 75 AS INT) END",
    "archived": "doc_id % 11 = 0",
    "folder": "'f' || doc_id % 13",
    "added": "DATE '2024-03-31' - CAST(doc_id % 60 AS INT)",
    "chunks": "n_chars",
    "source": "source",
    "lang": "lang",
}
LIB = "lib AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in COLUMNS.items()) + " FROM documents)"
LIVE = f"WITH {LIB}, live AS (SELECT * FROM lib WHERE NOT archived)"
LABEL = "coalesce(nullif(trim(title), ''), filename)"
KEYWORDS = "kw AS (SELECT doc_id, source AS name FROM lib UNION SELECT doc_id, lang FROM lib UNION SELECT doc_id, 'n' || doc_id % 97 FROM lib)"
FAMILIES = [("Tongue", ["en", "DE", "fr"]), ("Numbers", ["n1", "n2", "n3"]), ("Empty", [])]


def lib(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*(F.expr(v).alias(k) for k, v in COLUMNS.items()))


def keywords_of(docs: DataFrame) -> DataFrame:
    name = F.explode(F.array("source", "lang", F.concat(F.lit("n"), (F.col("doc_id") % 97).cast("string"))))
    return docs.select("doc_id", name.alias("name")).filter("name IS NOT NULL").distinct()


def families(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FAMILIES, "canonical string, members array<string>")


FAMILY_SQL = "fam AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', CAST([{', '.join(repr(m) for m in ms)}] AS VARCHAR[]))" for c, ms in FAMILIES) + ") AS t(canonical, members)), map AS (SELECT lower(name) AS member, max(canonical) AS canonical FROM (SELECT canonical, unnest(list_append(members, canonical)) AS name FROM fam) GROUP BY 1), units AS (SELECT DISTINCT doc_id, coalesce(canonical, name) AS name FROM kw LEFT JOIN map ON member = lower(name))"


@query(f"""{LIVE}, o AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'Own title' END AS o_title, CAST(NULL AS VARCHAR) AS o_authors, CASE WHEN doc_id % 2 = 0 THEN 2001 END AS o_year FROM lib WHERE doc_id % 10 < 4)
SELECT doc_id, filename, coalesce(nullif(o_title, ''), title) AS title, coalesce(nullif(o_authors, ''), authors) AS authors, coalesce(o_year, year) AS year
FROM live LEFT JOIN o USING (doc_id) WHERE health = 'healthy' AND format = 'pdf' AND folder = 'f3'""")
def list_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lib(spark, sf_dir)
    title = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, "Own title")
    own = docs.filter("doc_id % 10 < 4").select("doc_id", title.alias("o_title"), F.lit(None).cast("string").alias("o_authors"), F.when(F.col("doc_id") % 2 == 0, 2001).alias("o_year"))
    return catalog.list_documents(docs, own, "healthy", "pdf", docs.filter("folder = 'f3'"))


@query(f"""WITH {LIB}, s AS (SELECT doc_id, 'Old' AS o_title, CASE WHEN doc_id % 4 = 0 THEN 'X' END AS o_authors FROM lib WHERE doc_id % 3 = 0
), e AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ' ' WHEN 1 THEN title ELSE ' New ' END AS t, CASE WHEN doc_id % 8 = 2 THEN 'Y' END AS a, TRUE AS edited FROM lib WHERE doc_id % 5 = 0
), b AS (SELECT doc_id, CASE WHEN edited THEN CASE WHEN trim(t) <> '' AND trim(t) IS DISTINCT FROM title THEN trim(t) END ELSE o_title END AS o_title,
  CASE WHEN edited THEN CASE WHEN trim(a) <> '' AND trim(a) IS DISTINCT FROM authors THEN trim(a) END ELSE o_authors END AS o_authors FROM s FULL JOIN e USING (doc_id) JOIN lib USING (doc_id))
SELECT * FROM b WHERE o_title IS NOT NULL OR o_authors IS NOT NULL""")
def document_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, k = lib(spark, sf_dir), F.col("doc_id")
    stored = docs.filter("doc_id % 3 = 0").select("doc_id", F.lit("Old").alias("o_title"), F.when(k % 4 == 0, "X").alias("o_authors"))
    edits = docs.filter("doc_id % 5 = 0").select("doc_id", F.when(k % 4 == 0, " ").when(k % 4 == 1, F.col("title")).otherwise(" New ").alias("title"), F.when(k % 8 == 2, "Y").alias("authors"))
    return catalog.merge_overrides(stored, edits, docs)


PREFIXES = ("h791", "h7", "hx_%", "h0x0", "h1583", "none")


@query(f"""WITH {LIB}, p AS (SELECT unnest({list(PREFIXES)}) AS prefix), h AS (
  SELECT prefix, 0 AS place, doc_id FROM p JOIN lib ON starts_with(doc_hash, prefix) UNION ALL SELECT prefix, 1, doc_id FROM p JOIN lib ON starts_with(filename, prefix)
), f AS (SELECT prefix, place, count(DISTINCT doc_id) AS n, min(doc_id) AS doc_id FROM h GROUP BY prefix, place QUALIFY row_number() OVER (PARTITION BY prefix ORDER BY place) = 1)
SELECT prefix, CASE WHEN n = 1 THEN doc_id END AS doc_id, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'ok' END AS status FROM p LEFT JOIN f USING (prefix)""")
def resolve_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([(p,) for p in PREFIXES], "prefix string")
    return catalog.resolve_prefix(lib(spark, sf_dir), asked, ["doc_hash", "filename"], shortest=2)


@query(f"""{LIVE}, x AS (SELECT 'type' AS kind, doc_id FROM lib WHERE format = 'md' UNION ALL SELECT 'date', doc_id FROM lib WHERE DATE '2024-03-31' - added BETWEEN 1 AND 6
UNION ALL SELECT 'folder', doc_id FROM lib WHERE folder = 'f5' UNION ALL SELECT 'all', doc_id FROM lib) SELECT * FROM x""")
def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = lib(spark, sf_dir), None
    for kind, value in (("type", "md"), ("date", "week"), ("folder", "f5"), ("all", None)):
        one = catalog.in_collection(docs, kind, value, "2024-03-31").select(F.lit(kind).alias("kind"), "doc_id")
        out = one if out is None else out.unionByName(one)
    return out


AUTHOR_SQL = "list_filter(list_transform(regexp_split_to_array(authors, '\\s*(?:;|,|&|\\band\\b)\\s*'), lambda a: trim(a)), lambda a: a <> '')"


@query(f"""WITH {LIB}, a AS (SELECT *, {AUTHOR_SQL} AS n, {LABEL} AS label FROM lib)
SELECT doc_id, label, CASE WHEN authors IS NULL THEN NULL WHEN len(n) <= 3 THEN array_to_string(n, ', ') ELSE n[1] || ' et al.' END AS author, year FROM a
ORDER BY year DESC NULLS LAST, label, doc_id LIMIT 100""")
def documents_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.sorted_documents(lib(spark, sf_dir), "year").select("doc_id", "label", "author", "year").limit(100)


@query(f"""WITH {LIB} SELECT doc_id FROM lib WHERE contains(lower({LABEL}), 'eve f') OR contains(lower(filename), 'eve f') OR contains(lower(coalesce(authors, '')), 'eve f')""")
def filter_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.matching(lib(spark, sf_dir), " Eve F", catalog.label(), "filename", "authors").select("doc_id")


BUCKET_SQL = "CASE WHEN added >= DATE '2024-03-31' THEN 'today' WHEN DATE '2024-03-31' - added <= 6 THEN 'week' WHEN DATE '2024-03-31' - added <= 29 THEN 'month' ELSE 'earlier' END"


@query(f"""WITH {LIB} SELECT 'type' AS kind, format AS value, count(*) AS n FROM lib GROUP BY format
UNION ALL SELECT 'date', {BUCKET_SQL}, count(*) FROM lib GROUP BY 2""")
def document_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lib(spark, sf_dir)
    groups = {"type": F.col("format"), "date": catalog.date_bucket(F.col("added"), F.lit("2024-03-31").cast("date"))}
    types, dates = (catalog.count_groups(docs, g).select(F.lit(k).alias("kind"), "value", "n") for k, g in groups.items())
    return types.unionByName(dates)


SELECTED = ["Tongue", "Numbers"]
HELD_SQL = "held AS (SELECT doc_id FROM units WHERE name IN ('Tongue', 'Numbers') GROUP BY doc_id HAVING count(*) = 2)"


@query(f"WITH {LIB}, {KEYWORDS}, {FAMILY_SQL}, {HELD_SQL} SELECT doc_id FROM held")
def facet_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lib(spark, sf_dir)
    units = catalog.family_units(keywords_of(docs), catalog.canonical_map(families(spark)))
    return catalog.has_every(docs, units, SELECTED).select("doc_id")


@query(f"""WITH {LIB}, {KEYWORDS}, {FAMILY_SQL}, {HELD_SQL}, c AS (
  SELECT name, CAST(count(held.doc_id) AS BIGINT) AS n FROM units LEFT JOIN held USING (doc_id) GROUP BY name), t AS (SELECT name, count(*) AS docs FROM units GROUP BY name)
SELECT name, n, CASE WHEN name IN ('Tongue', 'Numbers') THEN 0 WHEN n > 0 THEN 1 ELSE 2 END AS state, docs, docs <= 10 AND name NOT IN ('Tongue', 'Numbers') AND (SELECT bool_or(docs > 10 OR name IN ('Tongue', 'Numbers')) FROM t) AS rare FROM c JOIN t USING (name)""")
def keyword_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lib(spark, sf_dir)
    units = catalog.family_units(keywords_of(docs), catalog.canonical_map(families(spark)))
    rare = catalog.rare_facets(catalog.unit_counts(units), SELECTED, 10).withColumnRenamed("n", "docs")
    return catalog.facets(docs, units, SELECTED).join(rare, "name")


@query(f"""WITH {LIB}, {KEYWORDS}, {FAMILY_SQL}, sel AS (SELECT * FROM (VALUES (0, 'de'), (1, 'en'), (2, 'n3'), (3, 'gone')) AS t(place, name))
SELECT min(place) AS place, coalesce(canonical, name) AS name FROM sel LEFT JOIN map ON member = lower(name) WHERE coalesce(canonical, name) IN (SELECT name FROM units) GROUP BY 2""")
def remap_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = catalog.canonical_map(families(spark))
    units = catalog.family_units(keywords_of(lib(spark, sf_dir)), mapping)
    chosen = spark.createDataFrame(list(enumerate(["de", "en", "n3", "gone"])), "place int, name string")
    return catalog.remap_selection(chosen, mapping, units)


@query(f"""WITH {LIB}, p AS (SELECT doc_id, 0 AS place, source AS name FROM lib UNION ALL SELECT doc_id, 1, lang FROM lib)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN name IN ('en', 'fr') THEN 0 ELSE 1 END, place, name) - 1 AS INT) AS place, name FROM p""")
def ordered_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = lib(spark, sf_dir).select("doc_id", F.posexplode(F.array("source", "lang")).alias("place", "name"))
    return catalog.ordered_units(placed, ["en", "fr"])


@query(f"WITH {LIB}, {KEYWORDS}, {FAMILY_SQL} SELECT canonical, len(members) = 0 AND canonical NOT IN (SELECT name FROM units) AS inherited, coalesce((SELECT count(DISTINCT doc_id) FROM units WHERE name = canonical), 0) AS n_docs FROM fam")
def keyword_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = families(spark)
    units = catalog.family_units(keywords_of(lib(spark, sf_dir)), catalog.canonical_map(own))
    counts = catalog.unit_counts(units).select(F.col("name").alias("canonical"), F.col("n").alias("n_docs"))
    return catalog.inherited_families(own, units).join(counts, "canonical", "left").select("canonical", "inherited", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


@query(f"{LIVE}, f AS (SELECT DISTINCT folder FROM lib UNION SELECT 'empty') SELECT folder, count(live.doc_id) AS n FROM f LEFT JOIN live USING (folder) GROUP BY folder")
def folder_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lib(spark, sf_dir)
    every = docs.select("folder").unionByName(spark.createDataFrame([("empty",)], "folder string"))
    return catalog.folder_counts(every, docs.select("folder", "doc_id"), docs)


@query(f"{LIVE} SELECT doc_id, doc_hash FROM live WHERE folder = 'f2'")
def folder_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lib(spark, sf_dir)
    return catalog.folder_documents(docs.select("folder", "doc_id"), docs, "f2")


@query(f"""WITH {LIB}, links AS (SELECT doc_id, folder FROM lib), added AS (SELECT * FROM links UNION SELECT doc_id, 'f1' FROM lib WHERE doc_id % 100 < 5)
SELECT * FROM added WHERE NOT (folder = 'f1' AND doc_id % 100 = 2)""")
def edit_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lib(spark, sf_dir)
    added = catalog.add_to_folder(docs.select("doc_id", "folder"), docs, "f1", docs.filter("doc_id % 100 < 5").select("doc_id").unionByName(spark.range(-3, 0).toDF("doc_id")))
    return catalog.remove_from_folder(added, "f1", docs.filter("doc_id % 100 = 2"))


@query("SELECT * FROM (VALUES ('Alpha'), ('Straße'), ('Beta')) AS t(name)")
def create_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that differ only by case, white space or ß are the same folder."""
    stored = spark.createDataFrame([("Alpha",), ("Straße",)], "name string")
    return catalog.create_named(stored, spark.createDataFrame([(" alpha ",), ("STRASSE",), ("beta",), ("Beta ",), ("  ",)], "name string"))


@query(f"""WITH {LIB}, c AS (SELECT conv_id AS id, 'Chat ' || conv_id || ' on en' AS label FROM conversations GROUP BY conv_id
), l AS (SELECT doc_id AS id, {LABEL} AS label FROM lib WHERE contains(lower({LABEL}), ' on en') OR contains(lower({LABEL}), 'and fr'))
SELECT * FROM (SELECT 'chat' AS kind, id, label, count(*) OVER () AS total FROM c WHERE contains(lower(label), 'on en') ORDER BY id DESC LIMIT 8)
UNION ALL SELECT * FROM (SELECT 'document', doc_id, {LABEL}, count(*) OVER () FROM lib WHERE contains(lower({LABEL}), 'on en') OR contains(lower(filename), 'on en') OR contains(lower(coalesce(authors, '')), 'on en') ORDER BY {LABEL}, doc_id LIMIT 8)""")
def search_everything(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id")).distinct()
    chats = chats.select("id", F.concat(F.lit("Chat "), "id", F.lit(" on en")).alias("label"), F.col("id").alias("last"), F.lit(False).alias("archived"))
    return catalog.search_everything(chats, lib(spark, sf_dir), "On EN")


FIELDS = ("title", "authors", "year", "health", "filename")


@query(f"WITH {LIB} " + " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) FILTER (trim(CAST({c} AS VARCHAR)) <> '') AS present, round(count(*) FILTER (trim(CAST({c} AS VARCHAR)) <> '') / count(*), 6) AS share FROM lib" for c in FIELDS))
def metadata_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.coverage(lib(spark, sf_dir), FIELDS)


@query(f"WITH {LIB} SELECT format, count(*) AS n, min(chunks) AS fewest, max(chunks) AS most, round(avg(chunks), 6) AS mean FROM lib GROUP BY format")
def chunk_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.chunk_spread(lib(spark, sf_dir))


@query(f"""WITH {LIB}, e AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'backfill_health' ELSE 'extract' END AS kind, added AS day FROM lib UNION ALL SELECT doc_id, 'backfill_health', added + 3 FROM lib WHERE doc_id % 3 = 0)
SELECT doc_id, health, (SELECT CAST(max(day) AS VARCHAR) FROM e WHERE e.doc_id = lib.doc_id AND kind = 'backfill_health') AS last_check FROM lib WHERE health IN ('broken', 'marginal')""")
def unhealthy_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lib(spark, sf_dir)
    events = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "backfill_health").otherwise("extract").alias("kind"), F.col("added").alias("day"))
    more = docs.filter("doc_id % 3 = 0").select("doc_id", F.lit("backfill_health").alias("kind"), F.date_add("added", 3).alias("day"))
    return catalog.unhealthy(docs, events.unionByName(more)).withColumn("last_check", F.col("last_check").cast("string"))


@query(f"""WITH {LIB}, a AS (SELECT doc_hash, doc_id, chunks FROM lib WHERE doc_id % 10 <> 1), b AS (SELECT doc_hash, CASE WHEN doc_id % 10 = 2 THEN -1 ELSE doc_id END AS doc_id, CASE WHEN doc_id % 10 = 3 THEN 0 ELSE chunks END AS chunks FROM lib WHERE doc_id % 10 <> 4)
SELECT coalesce(a.doc_hash, b.doc_hash) AS doc_hash, CASE WHEN b.doc_id IS NULL THEN 'only_in_a' WHEN a.doc_id IS NULL THEN 'only_in_b' WHEN a.doc_id <> b.doc_id THEN 'other_id' ELSE 'other_count' END AS problem
FROM a FULL JOIN b ON a.doc_hash = b.doc_hash WHERE a.doc_id IS DISTINCT FROM b.doc_id OR a.chunks <> b.chunks""")
def store_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, k = lib(spark, sf_dir), F.col("doc_id")
    b = docs.filter(k % 10 != 4).select("doc_hash", F.when(k % 10 == 2, -1).otherwise(k).alias("doc_id"), F.when(k % 10 == 3, 0).otherwise(F.col("chunks")).alias("chunks"))
    return catalog.store_differences(docs.filter(k % 10 != 1), b)


@query(f"{LIVE} SELECT (SELECT count(*) FROM live) AS n_live, (SELECT count(*) FROM live WHERE year IS NOT NULL) AS n_dated, (SELECT count(DISTINCT doc_hash) FROM lib) AS n_hashes")
def document_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lib(spark, sf_dir)
    there = ~F.col("archived")
    return docs.agg(F.count_if(there).alias("n_live"), F.count_if(there & F.col("year").isNotNull()).alias("n_dated"), F.count_distinct("doc_hash").alias("n_hashes"))
