"""Queries: column functions over text, on texts that are derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.vectors import overlap_fraction
from lectern.operators import keywords
from lectern.plans.library import LIB, lib
from lectern.plans.registry import query, table
from lectern.plans.search import STOPWORDS, TERMS_SQL

# A marked-up page for each document, in SQL that Spark and the oracle read alike.
PAGED = "'# Head ' || doc_id || chr(10) || '<!-- page:1 -->' || chr(10) || 'Running head ' || doc_id % 7 || chr(10) || '==> picture ' || doc_id || ' <==' || chr(10) || chr(10) || chr(10) || chr(10) || substr(coalesce(text, ''), 1, 200) || chr(10) || '<!-- page:2 -->' || chr(10) || 'Running head ' || doc_id % 7 || chr(10) || '| a | **b** |' || chr(10) || '  '"
PAGE_SQL = "'<!--\\s*page:\\d+\\s*-->'"
PAGED_SQL = f"p AS (SELECT doc_id, {PAGED} AS md FROM documents)"


@query(f"""WITH {PAGED_SQL} SELECT doc_id, len(regexp_split_to_array(md, {PAGE_SQL})) AS n_pages, trim(regexp_replace(md, {PAGE_SQL}, '', 'g'), ' ') AS cleaned,
  regexp_replace(regexp_replace(md, '(?m)^\\s*==>.*<==\\s*$', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g') AS plain, length(regexp_replace(regexp_replace(md, {PAGE_SQL}, '', 'g'), '[#*|\\-\\s]', '', 'g')) AS substance,
  (length(md) - length(replace(md, '==> picture', ''))) // 11 AS n_images, 'running head #' AS furniture FROM p""")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    md = F.col("md")
    pages = table(spark, sf_dir, "documents").select("doc_id", F.expr(PAGED).alias("md"))
    head = T.furniture_key(F.element_at(F.split(md, "\n"), 3))
    return pages.select("doc_id", F.size(T.split_pages(md)).cast("long").alias("n_pages"), T.clean_chunk(md).alias("cleaned"), T.strip_image_placeholders(md).alias("plain"), T.substantive_length(md).cast("long").alias("substance"), T.count_image_placeholders(md).cast("long").alias("n_images"), head.alias("furniture"))


# A reference for each document.
REFERENCE = "CASE doc_id % 5 WHEN 0 THEN 'Bell, A. (' || (1950 + doc_id % 75) || 'b) On things. doi:10.' || (1000 + doc_id % 9000) || '/ab.' || doc_id || ').' WHEN 1 THEN 'Dorn, C. Some work, ' || (1900 + doc_id % 99) || '.' WHEN 2 THEN 'No year 10.12/x here' WHEN 3 THEN 'In 12345 and 2010x (1899) or (20100)' ELSE 'See HTTPS://DOI.ORG/10.5555/Q(' || doc_id || ')-Z; 2001, 1999' END"
FILE = "CASE doc_id % 4 WHEN 0 THEN (91 + doc_id % 9) || '01.1234.pdf' WHEN 1 THEN 'x-' || (10 + doc_id % 15) || '11.' || (10000 + doc_id) || 'v2.pdf' WHEN 2 THEN '2413.12345.pdf' ELSE 'plain.pdf' END"
REFERENCE_SQL = f"""r AS (SELECT doc_id, {REFERENCE} AS ref, {FILE} AS file FROM documents), e AS (
  SELECT doc_id, file, ref, nullif(regexp_replace(regexp_extract(ref, '10\\.\\d{{4,9}}/[-._;()/:A-Za-z0-9]+'), '[.,;)\\]]+$', ''), '') AS doi,
  coalesce(nullif(regexp_extract(ref, '\\(((?:19|20)\\d{{2}})[a-z]?\\)', 1), ''), nullif(regexp_extract(ref, '\\b((?:19|20)\\d{{2}})\\b', 1), ''))::INT AS year FROM r)"""


@query(f"""WITH {REFERENCE_SQL}, y AS (SELECT *, nullif(regexp_extract(file, '(?:^|\\D)(\\d{{2}})(?:0[1-9]|1[0-2])\\.\\d{{4,5}}', 1), '')::INT AS yy FROM e)
SELECT doc_id, doi, year, CASE WHEN yy >= 91 THEN 1900 + yy ELSE 2000 + yy END AS arxiv, CASE WHEN year BETWEEN 1800 AND 2025 THEN year END AS plausible,
  CAST(round(CASE WHEN year IS NULL THEN 0 ELSE 0.3 END + 0.25 + CASE WHEN length(ref) >= 30 THEN 0.25 ELSE 0 END + CASE WHEN doi IS NULL THEN 0 ELSE 0.2 END, 2) AS DOUBLE) AS confidence FROM y""")
def reference_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(REFERENCE).alias("ref"), F.expr(FILE).alias("file"))
    rows = rows.select("*", T.extract_doi(F.col("ref")).alias("doi"), T.citation_year(F.col("ref")).alias("year"), T.arxiv_year(F.col("file")).alias("arxiv"))
    long = F.when(F.length("ref") >= 30, F.col("ref"))
    confidence = F.round(T.citation_confidence(F.col("year"), F.col("ref"), long, F.col("doi")), 2).alias("confidence")
    return rows.select("doc_id", "doi", "year", "arxiv", T.plausible_year(F.col("year"), F.lit(2024)).alias("plausible"), confidence)


LABELS = "CASE doc_id % 8 WHEN 0 THEN 'x y' WHEN 1 THEN 'ab' WHEN 2 THEN 'graph 12' WHEN 3 THEN 'a graph' WHEN 4 THEN 'dense graphs' WHEN 5 THEN 'Study of {ice} & snow' WHEN 6 THEN 'studies' ELSE source END"


@query(f"""WITH l AS (SELECT doc_id, {LABELS} AS label, list_sort(list_distinct([source, lang])) AS hashes FROM documents)
SELECT doc_id, length(replace(label, ' ', '')) <= 2 OR len(list_filter(regexp_split_to_array(label, '\\s+'), lambda t: regexp_matches(t, '^\\d+$') OR length(t) = 1)) > 0 AS artifact,
  regexp_replace(label, '([{{}}])', '\\\\\\1', 'g') AS bibtex, 'topic-' || substr(sha256(array_to_string(hashes, ',')), 1, 10) AS topic,
  CASE WHEN ends_with(label, 'ies') AND length(label) > 4 THEN label || ',' || left(label, length(label) - 3) || 'y,' || left(label, length(label) - 1) WHEN regexp_matches(label, '[^s]s$') AND length(label) > 3 AND NOT regexp_matches(label, '(?:ses|xes|zes|ches|shes)$') THEN label || ',' || left(label, length(label) - 1) ELSE label END AS stems FROM l WHERE NOT regexp_matches(label, '(?:ses|xes|zes|ches|shes)$')""")
def label_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(LABELS).alias("label"), F.array_distinct(F.array_compact(F.array("source", "lang"))).alias("hashes"))
    rows = rows.filter(~F.col("label").rlike("(?:ses|xes|zes|ches|shes)$"))
    label = F.col("label")
    return rows.select("doc_id", T.is_label_artifact(label).alias("artifact"), T.escape_bibtex(label).alias("bibtex"), T.topic_id(F.col("hashes")).alias("topic"), F.array_join(T.stem_candidates(label), ",").alias("stems"))


SIZE = "CASE doc_id % 6 WHEN 0 THEN n_chars WHEN 1 THEN n_chars * 1000 WHEN 2 THEN n_chars * 100000 WHEN 3 THEN n_chars * 100000000 WHEN 4 THEN NULL ELSE 1023 END"


def unit_sql(k: int, unit: str) -> str:
    one = 1 << 10 * k
    return f"WHEN n < {one << 10 if k < len(T.UNITS) else 1 << 62} THEN CASE WHEN n < {10 * one} THEN (n * 20 + {one}) // {2 * one} // 10 || '.' || (n * 20 + {one}) // {2 * one} % 10 ELSE CAST((n * 2 + {one}) // {2 * one} AS VARCHAR) END || ' {unit}'"


@query(f"""WITH s AS (SELECT doc_id, CAST({SIZE} AS BIGINT) AS n, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS flat FROM documents)
SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' {' '.join(unit_sql(k, u) for k, u in enumerate(T.UNITS, 1))} ELSE '—' END AS size,
  CASE WHEN length(flat) <= 90 THEN flat ELSE regexp_replace(substr(flat, 1, 91), '\\s+\\S*$', '') || '…' END AS preview FROM s""")
def display_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.format_bytes(F.expr(SIZE)).alias("size"), T.preview(F.coalesce("text", F.lit(""))).alias("preview"))


@query(f"""WITH {LIB} SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'new' WHEN doc_id % 3 = 0 THEN 'ingested' ELSE 'changed' END AS status,
  '[' || (doc_id % 9 + 1) || '] ' || filename || CASE WHEN year IS NULL THEN '' ELSE ' · p.' || year END || CASE WHEN title IS NULL THEN '' ELSE ' · "' || title || '"' END AS citation FROM lib""")
def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    citation = T.format_citation(k % 9 + 1, F.col("filename"), F.col("year"), F.col("title"))
    return lib(spark, sf_dir).select("doc_id", T.file_status(k % 7 != 0, k % 5 != 0, k % 3 == 0).alias("status"), citation.alias("citation"))


@query("""WITH c AS (SELECT conv_id, turn, role, CASE turn % 4 WHEN 0 THEN [1, 2] WHEN 1 THEN [9] WHEN 2 THEN [2, 3] ELSE CAST([] AS INT[]) END AS n, [CAST(0.1 * (conv_id % 10) AS DOUBLE), 0.05, NULL] AS s FROM conversations
), g AS (SELECT *, list_filter(list_transform(list_filter(n, lambda x: x BETWEEN 1 AND 3), lambda x: s[x]), lambda v: v IS NOT NULL) AS got, len(list_filter(n, lambda x: x BETWEEN 1 AND 3)) AS k FROM c)
SELECT conv_id, turn, role, CASE WHEN k = 0 THEN 'unsupported' WHEN list_max(got) >= 0.3 THEN 'ok' ELSE 'weak' END AS marker FROM g""")
def claim_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn") % 4
    numbers = F.when(turn == 0, F.array(F.lit(1), F.lit(2))).when(turn == 1, F.array(F.lit(9))).when(turn == 2, F.array(F.lit(2), F.lit(3))).otherwise(F.array().cast("array<int>"))
    scores = F.array(0.1 * (F.col("conv_id") % 10), F.lit(0.05), F.lit(None).cast("double"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", T.claim_marker(numbers, scores).alias("marker"))


@query("""WITH c AS (SELECT conv_id, turn, role, string_split(text, ' ')[1:3] AS e, string_split(lower(text), ' ')[2:5] AS f FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, role, CASE WHEN len(e) > 0 THEN round(len(list_filter(e, lambda x: len(list_filter(f, lambda y: contains(y, lower(x)) OR contains(lower(x), y))) > 0)) / len(e), 6) END AS share FROM c""")
def citation_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of a turn's first three words that meet one of its next ones: what scores cited names."""
    turns = table(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    expected, found = F.slice(F.split("text", " "), 1, 3), F.slice(F.split(F.lower("text"), " "), 2, 4)
    return turns.select("conv_id", "turn", "role", F.round(overlap_fraction(expected, found), 6).alias("share"))


@query("WITH " + TERMS_SQL + """ SELECT * FROM (SELECT doc, term, tf, row_number() OVER (PARTITION BY doc ORDER BY tf DESC, len(string_split(term, ' ')) DESC, term) AS rank FROM counts) WHERE rank <= 15""")
def abstract_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.abstract_candidates(table(spark, sf_dir, "documents"), STOPWORDS).select("doc", "term", "tf", "rank")
