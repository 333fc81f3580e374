"""Queries: reference lists that are derived from the documents, resolved to the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import references as R
from lectern.operators import fuzzy, references
from lectern.operators.scratch import materialize
from lectern.plans.library import LIB, lib
from lectern.plans.registry import query, table, texts

# A paper for each document, in SQL that Spark and the oracle read alike.
BODY = """CASE doc_id % 3 WHEN 0 THEN 'Ahead of all' || chr(10) || '- Bell, A. (' || (1950 + doc_id % 75) || 'a). Title of number ' || doc_id % 50 || ' here. _Journal_ 3.' || chr(10) || '[2] Dorn, C. Some longer work on topic ' || doc_id % 9 || '. *Venue*, 12-30, 2004.' || chr(10) || '3. Short' || chr(10) || '- No year in this one, which is kept for its doi 10.1234/ab.' || doc_id % 40 || ').'
WHEN 1 THEN 'see 1. Frey, Eve and Hall, G. (2001) Of things. More text. 2. Jung I. Title words and more. Journal of That, 1998 3. Lund, Kim, Nolte, Max. A study, ' || (1960 + doc_id % 60)
ELSE 'Órtiz, José. Well known results. Press, 1990.' || chr(10) || chr(10) || '  ' || chr(10) || 'O''Hara, P. Nothing but a name without any date at all but with very many words in it.' || chr(10) || chr(10) || 'Tiny (1999)' END"""
PAPER = f"""'Intro ' || doc_id || chr(10) || CASE doc_id % 4 WHEN 0 THEN '## References' WHEN 1 THEN '# **Bibliography**' WHEN 2 THEN 'references' ELSE '### Works  Cited  ' END || chr(10) || {BODY} || chr(10) || CASE WHEN doc_id % 5 = 0 THEN '## Appendix A' || chr(10) || '- tail of the text' WHEN doc_id % 5 = 1 THEN '#Funding' || chr(10) || '- tail' ELSE '' END"""
PARSED_SQL = rf"""paper AS (SELECT doc_id AS doc, {PAPER} AS md FROM documents), blk AS (SELECT doc, regexp_extract(md, '(?im){R.SECTION}([\s\S]*)', 1) AS body FROM paper WHERE regexp_matches(md, '(?im){R.SECTION}')
), block AS (SELECT doc, CASE WHEN regexp_matches(body, '(?im){R.NEXT}') THEN regexp_extract(body, '(?i)\A([\s\S]*?)(?m:{R.NEXT})', 1) ELSE body END AS b FROM blk
), entries AS (SELECT doc, CASE WHEN len(regexp_extract_all(b, '(?m)^{R.ENTRY}')) >= 3 THEN string_split(regexp_replace(b, '(?m)^({R.ENTRY})', chr(1) || '\1', 'g'), chr(1))[2:]
  WHEN len(regexp_extract_all(b, '\s\d{{1,3}}\.\s+[A-ZÀ-Ÿ]')) >= 2 THEN string_split(regexp_replace(b, '(\s)(\d{{1,3}}\.\s+[A-ZÀ-Ÿ])', '\1' || chr(1) || '\2', 'g'), chr(1))
  ELSE regexp_split_to_array(b, '\n\s*\n') END AS p FROM block
), clean AS (SELECT doc, list_filter(list_transform(p, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM entries
), each AS (SELECT doc, CAST(i - 1 AS INT) AS place, trim(regexp_replace(trim(regexp_replace(p[i], '^{R.ENTRY}', '')), '\s+', ' ', 'g')) AS raw FROM clean, unnest(range(1, len(p) + 1)) AS u(i)
), f AS (SELECT *, nullif(regexp_replace(regexp_extract(raw, '10\.\d{{4,9}}/[-._;()/:A-Za-z0-9]+'), '[.,;)\]]+$', ''), '') AS doi, nullif(regexp_extract(raw, '{R.YEAR_INSIDE}'), '') AS yi, nullif(regexp_extract(raw, '{R.YEAR_LOOSE}'), '') AS yl FROM each
), g AS (SELECT *, coalesce(yi, yl) AS y, CAST(nullif(regexp_extract(coalesce(yi, yl), '\d+'), '') AS INT) AS year, strpos(raw, coalesce(yi, yl)) AS at_ FROM f
), bare AS (SELECT *, rtrim(regexp_replace(trim(substr(raw, 1, at_ - 1)), '[,.]+$', '')) AS before, regexp_replace(trim(substr(raw, at_ + length(y))), '^[.,)( ]+', '') AS after, at_ - 1 > 0.6 * length(raw) AS last FROM g
), m AS (SELECT *, CASE WHEN regexp_matches(before, '{R.EMPHASIS}') THEN rtrim(regexp_replace(trim(regexp_extract(before, '^(.*?)(?:{R.EMPHASIS})', 1)), '[,.]+$', '')) ELSE before END AS both_, regexp_matches(before, '{R.EMPHASIS}') AS em FROM bare
), s AS (SELECT *, CASE WHEN em AND regexp_matches(both_, '[a-z\)]\.\s+') THEN string_split(regexp_replace(both_, '([a-z\)])\.\s+', '\1' || chr(1)), chr(1)) WHEN contains(both_, '. ') THEN [both_[:strpos(both_, '. ') - 1], both_[strpos(both_, '. ') + 2:]] ELSE [both_] END AS parts FROM m
), t AS (SELECT doc, place, raw, doi, year, rtrim(regexp_replace(trim(CASE WHEN y IS NULL THEN string_split(regexp_replace(raw, '([.!?])\s+', '\1' || chr(1)), chr(1))[1] WHEN last THEN parts[1] ELSE nullif(before, '') END), '[,.]+$', '')) AS authors,
  rtrim(regexp_replace(trim(CASE WHEN last THEN parts[2] WHEN regexp_matches(after, '{R.EMPHASIS}') THEN regexp_extract(after, '^(.*?)(?:{R.EMPHASIS})', 1) ELSE string_split(regexp_replace(after, '([.!?])\s+', '\1' || chr(1)), chr(1))[1] END), '[,.]+$', '')) AS title FROM s
), refs AS (SELECT doc, place, raw, doi, year, authors, CASE WHEN length(title) >= 5 THEN title END AS title FROM t WHERE length(raw) >= 20 AND NOT (year IS NULL AND doi IS NULL AND length(raw) < 60))"""


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", F.expr(PAPER).alias("text"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(references.extract(papers(spark, sf_dir)), "references")


@query(f"""WITH {PARSED_SQL} SELECT *, CAST(round(CASE WHEN year IS NULL THEN 0 ELSE 0.3 END + CASE WHEN authors <> '' THEN 0.25 ELSE 0 END + CASE WHEN length(title) >= 10 THEN 0.25 ELSE 0 END + CASE WHEN doi IS NULL THEN 0 ELSE 0.2 END, 2) AS DOUBLE) AS confidence FROM refs""")
def extract_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir)


@query(f"""WITH {PARSED_SQL}, n AS (SELECT doc, count(*) AS n FROM refs GROUP BY doc) SELECT p.doc, b.doc IS NOT NULL AS has_section, coalesce(n, 0) AS n, b.doc IS NOT NULL AND coalesce(n, 0) < 5 AS needs_more FROM paper p LEFT JOIN blk b ON b.doc = p.doc LEFT JOIN n ON n.doc = p.doc""")
def reference_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.extraction_notes(papers(spark, sf_dir), found(spark, sf_dir))


NAMES = ["Hodgkin, A. L.", "A. L. Hodgkin", "A. L. HODGKIN AND A. F. HUXLEY", "Suarez LE, Yovel Y", "Eric Jonas, Konrad Kording", "Órtiz, José", "O'Hara, P.", "", "A. B.", "Müller-Lüdenscheidt", "de la Cruz, M., Other, B."]
SURNAMES = ["hodgkin", "hodgkin", "hodgkin", "suarez", "jonas", "jose", "o hara", None, None, "muller ludenscheidt", "cruz"]


# The authors of each document: one of the ways to write names, some with the document's number.
AUTHORS = "CASE doc_id % 12 " + " ".join(f"WHEN {k} THEN '{n.replace(chr(39), chr(39) * 2)}'" for k, n in enumerate(NAMES)) + " ELSE 'Name' || chr(97 + cast(doc_id % 26 AS INT)) || ', Q. and Other, R.' END"


@query("SELECT doc_id, CASE doc_id % 12 " + " ".join(f"WHEN {k} THEN {'NULL' if n is None else repr(n)}" for k, n in enumerate(SURNAMES)) + " ELSE 'name' || chr(97 + CAST(doc_id % 26 AS INT)) END AS surname FROM documents")
def first_surnames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", R.first_surname(F.expr(AUTHORS)).alias("surname"))


@query(f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents) SELECT doc_id, trim(lower(regexp_replace(strip_accents(t), '[^a-zA-Z0-9]+', ' ', 'g'))) AS name FROM d")
def normalized_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", R.normalize_name(F.coalesce("text", F.lit(""))).alias("name"))


# The library's papers: a doi, authors or a title that references name.
KNOWN = "k AS (SELECT doc_id, filename, CASE WHEN doc_id % 4 = 0 THEN '10.1234/AB.' || doc_id % 40 END AS doi, CASE WHEN doc_id % 4 = 1 THEN 'A. Bell and others' END AS authors, CASE WHEN doc_id % 4 = 1 THEN CAST(1950 + doc_id % 75 AS INT) END AS year, CASE WHEN doc_id % 4 = 2 THEN 'Some longer work on topic ' || doc_id % 9 ELSE 'Other' END AS title FROM lib WHERE NOT archived)"
RESOLVED_SQL = f"""{LIB}, {KNOWN}, {PARSED_SQL}, r AS (SELECT doc, place, (SELECT min(doc_id) FROM k WHERE lower(k.doi) = lower(refs.doi)) AS a, CASE WHEN starts_with(authors, 'Bell') THEN (SELECT min(doc_id) FROM k WHERE k.year = refs.year AND k.authors IS NOT NULL) END AS b, (SELECT min(doc_id) FROM k WHERE lower(k.title) = lower(refs.title)) AS c FROM refs
), resolved AS (SELECT doc, place, coalesce(a, b, c) AS target, CASE WHEN a IS NOT NULL THEN 'doi' WHEN b IS NOT NULL THEN 'author_year' WHEN c IS NOT NULL THEN 'title' END AS how FROM r)"""


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    doi = F.when(k % 4 == 0, F.concat(F.lit("10.1234/AB."), k % 40))
    title = F.when(k % 4 == 2, F.concat(F.lit("Some longer work on topic "), k % 9)).otherwise("Other")
    return lib(spark, sf_dir).filter("NOT archived").select("doc_id", "filename", doi.alias("doi"), F.when(k % 4 == 1, "A. Bell and others").alias("authors"), F.when(k % 4 == 1, (1950 + k % 75).cast("int")).alias("year"), title.alias("title"))


def resolved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    refs, library = found(spark, sf_dir), known(spark, sf_dir)
    return refs, materialize(references.resolve(refs, library), "resolved"), library


@query(f"WITH {RESOLVED_SQL} SELECT * FROM resolved")
def resolve_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(spark, sf_dir)[1]


@query()
def fuzzy_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References by the rules, the last of which takes titles that are alike; the tests compare all pairs."""
    return references.resolve(found(spark, sf_dir), known(spark, sf_dir), fuzzy.RATIO)


@query(f"WITH {RESOLVED_SQL} SELECT doc, place, target, how IN ('doi', 'title') AS credible FROM resolved WHERE target IS NOT NULL")
def credible_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.credible(*resolved(spark, sf_dir))


@query(f"WITH {RESOLVED_SQL} SELECT doc, place, raw, refs.year, target, filename FROM refs JOIN resolved USING (doc, place) LEFT JOIN k ON doc_id = target")
def cites_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.cites_out(*resolved(spark, sf_dir))


@query(f"WITH {RESOLVED_SQL} SELECT DISTINCT target, doc, k.filename FROM resolved JOIN k ON doc_id = doc WHERE target <> doc")
def cited_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, to, library = resolved(spark, sf_dir)
    return references.cited_by(to, library)


@query(f"WITH {PARSED_SQL}, o AS (SELECT doc, place, CAST(row_number() OVER (PARTITION BY doc ORDER BY year DESC NULLS LAST, place) AS INT) AS rank, count(*) OVER (PARTITION BY doc) AS total FROM refs) SELECT doc, rank, place, total FROM o WHERE rank <= 2")
def reference_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.reference_views(found(spark, sf_dir), 2)


@query(f"""WITH {LIB}, b AS (SELECT *, CASE WHEN format IN ('md', 'txt') THEN 'note_paper_' || doc_id WHEN authors IS NULL THEN 'misc_' || substr(CAST(doc_id AS VARCHAR), 1, 8) ELSE CASE doc_id % 4 WHEN 1 THEN 'bell' WHEN 2 THEN 'frey' ELSE 'jung' END || coalesce('_' || year, '') END AS base FROM lib
), k AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY base) AS n FROM b), e AS (
  SELECT doc_id, base || CASE WHEN n = 1 THEN '' WHEN place < 26 THEN chr(CAST(97 + place AS INT)) ELSE '_' || place END AS key, CASE WHEN format IN ('pdf', 'epub', 'html') AND authors IS NOT NULL AND year IS NOT NULL THEN 'article' ELSE 'misc' END AS kind, authors, title, year FROM k)
SELECT doc_id, key, kind, '@' || kind || '{{' || key || ',' || chr(10) || concat_ws(',' || chr(10), '  author = {{' || authors || '}}', CASE WHEN trim(title) <> '' THEN '  title = {{' || title || '}}' END, '  year = {{' || year || '}}') || chr(10) || '}}' AS entry FROM e""")
def bibtex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.bibtex(lib(spark, sf_dir))
