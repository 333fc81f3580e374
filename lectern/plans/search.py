"""Queries: tokens, sparse and dense ranking, fusion, keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import TOKEN, TOKEN_PART, doc_hash
from lectern.operators import contrast, index, keywords, retrieve
from lectern.plans.registry import query, table, texts

FOLD = "replace(lower(coalesce({0}, '')), 'ß', 'ss')"


def tokens_sql(text: str) -> str:
    return f"regexp_extract_all({FOLD.format(text)}, '{TOKEN}')"


SUB_SQL = f"""
sub AS (
  SELECT doc_id AS doc, regexp_extract_all({FOLD.format("text")}, '{TOKEN_PART}') AS w FROM documents
)"""

# The classic English stop list of Apache Lucene, the queries' own choice.
STOPWORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
STOP_SQL = "(" + ", ".join(f"'{w}'" for w in STOPWORDS) + ")"

TERMS_SQL = f"""
tok AS (
  SELECT doc_id AS doc, i, w[i] AS t,
         w[i] NOT IN {STOP_SQL} AND string_split_regex(w[i], '[./]')[1] NOT IN {STOP_SQL}
         AND NOT regexp_matches(w[i], '^(?:[0-9]{{4}}[a-z]|[a-z][0-9]{{4,}}|10\\.[0-9]{{4,5}})$') AS ok
  FROM (SELECT doc_id, {tokens_sql("text")} AS w FROM documents), unnest(range(1, len(w) + 1)) AS u(i)
), seq AS (
  SELECT doc, t AS t1, ok AS k1, lead(t) OVER o AS t2, lead(ok) OVER o AS k2, lead(t, 2) OVER o AS t3, lead(ok, 2) OVER o AS k3
  FROM tok WINDOW o AS (PARTITION BY doc ORDER BY i)
), grams AS (
  SELECT doc, t1 AS term FROM seq WHERE k1
  UNION ALL SELECT doc, t1 || ' ' || t2 FROM seq WHERE k1 AND k2 AND t1 <> t2
  UNION ALL SELECT doc, t1 || ' ' || t2 || ' ' || t3 FROM seq WHERE k1 AND k2 AND k3 AND NOT (t1 = t2 AND t2 = t3)
), counts AS (
  SELECT doc, term, count(*) AS tf FROM grams
  WHERE length(replace(term, ' ', '')) >= 3 AND regexp_matches(term, '[a-z]')
  GROUP BY doc, term
)"""


@query(f"WITH {SUB_SQL} SELECT doc AS doc_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct FROM sub")
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = index.subtokens(F.col("text"))
    return texts(spark, sf_dir).select("doc_id", F.size(words).cast("long").alias("n_tokens"), F.size(F.array_distinct(words)).cast("long").alias("n_distinct"))


@query(f"WITH {SUB_SQL}, e AS (SELECT doc, unnest(w) AS term FROM sub) SELECT term, count(*) AS tf, count(DISTINCT doc) AS df FROM e GROUP BY term")
def df_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.term_stats(texts(spark, sf_dir), "text")


BM25_SQL = f"""
{SUB_SQL}, q AS (
  SELECT item_id AS query, unnest({tokens_sql("text")}) AS phrase FROM benchmark
), weights AS (
  SELECT query, phrase, count(*) AS weight, list_filter(string_split_regex(phrase, '[./]'), lambda t: t <> '') AS parts FROM q GROUP BY query, phrase
), phrases AS (SELECT DISTINCT phrase, parts FROM weights
), places AS (SELECT doc, i, w[i] AS term, w FROM sub, unnest(range(1, len(w) + 1)) AS u(i)
), counts AS (
  SELECT phrase, doc, count(*) AS tf FROM places JOIN phrases ON term = parts[1]
  WHERE w[i:i + len(parts) - 1] = parts GROUP BY phrase, doc
), dfs AS (SELECT phrase, count(*) AS df FROM counts GROUP BY phrase
), totals AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM sub
), idfs AS (
  SELECT phrase, avgdl, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf FROM dfs, totals
), scored AS (
  SELECT query, doc, round(sum(weight * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avgdl))), 6) AS score
  FROM counts JOIN idfs USING (phrase) JOIN weights USING (phrase) JOIN sub USING (doc) {{scope}} GROUP BY query, doc
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM scored)"""


def bm25_sql(k: int, scope: str = "") -> str:
    return "WITH " + BM25_SQL.replace("{scope}", scope) + f" SELECT query, doc, score, rank FROM ranked WHERE rank <= {k}"


@query(bm25_sql(10))
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.bm25(texts(spark, sf_dir), table(spark, sf_dir, "benchmark"), 10)


@query(bm25_sql(10, "JOIN documents d ON d.doc_id = doc AND d.lang = 'en'"))
def bm25_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.bm25(texts(spark, sf_dir), table(spark, sf_dir, "benchmark"), 10, scope=F.col("lang") == "en")


DENSE_SQL = """
sims AS (
  SELECT q.vec_id AS query, v.vec_id AS doc,
         round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]))), 5) AS score
  FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id {0}
), dense AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM sims) WHERE rank <= {1}
)"""


@query("WITH " + DENSE_SQL.format("AND q.vec_id IN (SELECT item_id FROM benchmark)", 20) + " SELECT query, doc, score, rank FROM dense")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_arm(spark, sf_dir, 20)


def dense_arm(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The vectors numbered like the benchmark items are their queries."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    queries = vectors.join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id")), "id", "left_semi")
    return retrieve.dense_rank(vectors, queries, k)


HYBRID_SQL = (
    "WITH "
    + BM25_SQL.replace("{scope}", "")
    + ", "
    + DENSE_SQL.format("AND q.vec_id IN (SELECT item_id FROM benchmark)", 20)
    + """, arms AS (
  SELECT query, doc, 0.4 / (60 + rank) AS part FROM ranked WHERE rank <= 20
  UNION ALL SELECT query, doc, 0.6 / (60 + rank) FROM dense
), fused AS (SELECT query, doc, round(sum(part), 9) AS score FROM arms GROUP BY query, doc
), best AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM fused)"""
)


@query(HYBRID_SQL + " SELECT query, doc, score, rank FROM best WHERE rank <= 10")
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    sparse = index.bm25(texts(spark, sf_dir), table(spark, sf_dir, "benchmark"), 20)
    return retrieve.fuse([(sparse, 0.4), (dense_arm(spark, sf_dir, 20), 0.6)], 10)


@query(
    HYBRID_SQL
    + """, hashed AS (
  SELECT query, doc, score, rank, d.source, substr(sha256(coalesce(d.text, '')), 1, 16) AS hash FROM best JOIN documents d ON d.doc_id = doc WHERE rank <= 60
), unique_ AS (
  SELECT query, doc, score, source, rank FROM (SELECT *, row_number() OVER (PARTITION BY query, hash ORDER BY rank, doc) AS k FROM hashed) WHERE k = 1
), dense_rank_ AS (SELECT query, doc, score, source, row_number() OVER (PARTITION BY query ORDER BY rank, doc) AS rank FROM unique_
), children AS (SELECT *, row_number() OVER (PARTITION BY query, source ORDER BY score DESC, rank) AS k FROM dense_rank_
), parents AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, rank) AS place FROM children WHERE k = 1)
SELECT query, source, doc, score, place FROM parents WHERE place <= 10"""
)
def retrieve_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuse, drop equal texts, and keep the best document of each source (its parent)."""
    docs = table(spark, sf_dir, "documents")
    sparse = index.bm25(docs, table(spark, sf_dir, "benchmark"), 20)
    fused = retrieve.fuse([(sparse, 0.4), (dense_arm(spark, sf_dir, 20), 0.6)], 60)
    known = fused.join(docs.select(F.col("doc_id").alias("doc"), "source", doc_hash(F.coalesce("text", F.lit(""))).alias("hash")), "doc")
    return retrieve.collapse_to_parents(retrieve.dedupe(known, ["hash"]), ["source"], 10).select("query", "source", "doc", "score", "place")


@query(
    "WITH "
    + BM25_SQL.replace("{scope}", "")
    + """, a AS (SELECT query, doc, rank FROM ranked WHERE rank <= 10
), scoped AS (
  SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM scored JOIN documents d ON d.doc_id = doc WHERE d.lang = 'en'
), b AS (SELECT * FROM scoped WHERE rank <= 10)
SELECT coalesce(a.query, b.query) AS query, coalesce(a.doc, b.doc) AS doc, a.rank AS rank_a, b.rank AS rank_b,
       CASE WHEN b.rank IS NULL THEN 'only_in_a' WHEN a.rank IS NULL THEN 'only_in_b' ELSE 'in_both' END AS status, a.rank - b.rank AS delta
FROM a FULL JOIN b ON a.query = b.query AND a.doc = b.doc"""
)
def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.compare_runs(bm25_topk(spark, sf_dir), bm25_scoped(spark, sf_dir))


@query(
    "WITH "
    + BM25_SQL.replace("{scope}", "")
    + """, expected AS (
  SELECT DISTINCT item_id AS query, doc_id AS doc FROM benchmark b JOIN documents d ON contains(d.text, b.text)
)
SELECT e.query, round(count(r.doc) / count(*), 6) AS recall
FROM expected e LEFT JOIN ranked r ON r.query = e.query AND r.doc = e.doc AND r.rank <= 10 GROUP BY e.query"""
)
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that quote an item in full are the ones expected for it."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("item"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    expected = retrieve.quoting(docs, items)
    return retrieve.recall_at(bm25_topk(spark, sf_dir), expected, 10)


@query("""WITH h AS (SELECT DISTINCT substr(sha256(coalesce(text, '')), 1, 16) AS h FROM documents
), p AS (SELECT substr(h, 1, 4) AS prefix, sha256(string_agg(h, chr(10) ORDER BY h)) AS d, count(*) AS n FROM h GROUP BY 1)
SELECT sha256(string_agg(d, chr(10) ORDER BY prefix)) AS digest, CAST(sum(n) AS BIGINT) AS n FROM p""")
def doc_set_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.set_digest(table(spark, sf_dir, "documents").select(doc_hash(F.coalesce("text", F.lit(""))).alias("h")))


@query(
    """WITH h AS (SELECT sha256(CAST(doc_id AS VARCHAR)) AS h FROM documents)
SELECT CAST(sum(('0x' || substr(h, 1, 8))::BIGINT) AS BIGINT) AS s0, CAST(sum(('0x' || substr(h, 9, 8))::BIGINT) AS BIGINT) AS s1,
       CAST(sum(('0x' || substr(h, 17, 8))::BIGINT) AS BIGINT) AS s2, CAST(sum(('0x' || substr(h, 25, 8))::BIGINT) AS BIGINT) AS s3, count(*) AS n FROM h"""
)
def index_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(index.index_fingerprint(F.col("doc_id")).alias("x")).select("x.*")


@query("WITH " + TERMS_SQL + """, d AS (SELECT term, count(*) AS df FROM counts GROUP BY term), n AS (SELECT count(*) AS n FROM documents), s AS (
  SELECT doc, term, tf, df, round((1 + ln(tf)) * (ln((n + 1) / (df + 1)) + 1), 6) AS score FROM counts JOIN d USING (term), n)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY score DESC, term) AS rank FROM s) WHERE rank <= 15""")
def tfidf_keywords_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.tf_idf_top(texts(spark, sf_dir), STOPWORDS)


GREEDY_SQL = """list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(ranked, lambda x: [x.term])), lambda acc, x: CASE
  WHEN len(acc) < 15 AND len(list_filter(acc, lambda y: contains(' ' || y || ' ', ' ' || x[1] || ' ') OR contains(' ' || x[1] || ' ', ' ' || y || ' '))) = 0 THEN list_concat(acc, x) ELSE acc END)"""


@query("WITH " + TERMS_SQL + f""", d AS (SELECT term, count(*) AS df FROM counts GROUP BY term), n AS (SELECT count(*) AS n FROM documents), s AS (
  SELECT doc, term, round((1 + ln(tf)) * (ln((n + 1) / (df + 1)) + 1), 6) AS score FROM counts JOIN d USING (term), n
), r AS (SELECT doc, list({{'term': term, 'score': score}} ORDER BY score DESC, term) AS ranked FROM s GROUP BY doc
), g AS (SELECT doc, {GREEDY_SQL} AS taken FROM r
), e AS (SELECT doc, unnest(taken) AS term, unnest(range(1, len(taken) + 1)) AS rank FROM g)
SELECT e.doc, e.term, s.score, CAST(e.rank AS INT) AS rank FROM e JOIN s ON e.doc = s.doc AND e.term = s.term""")
def tfidf_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.tf_idf_top(texts(spark, sf_dir), STOPWORDS, nested=False).select("doc", "term", "score", "rank")


@query("WITH " + TERMS_SQL + """, b AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM counts GROUP BY term)
SELECT term, df, tf, round(df * (1 + ln(tf)), 6) AS score FROM b
WHERE df BETWEEN 2 AND (SELECT greatest(2, CAST(floor(0.7 * count(*)) AS BIGINT)) FROM documents) ORDER BY score DESC, term LIMIT 60""")
def corpus_band_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    return keywords.corpus_band(keywords.doc_term_counts(docs, STOPWORDS), docs.count())


CVALUE_SQL = (
    "WITH "
    + TERMS_SQL
    + """, f AS (SELECT term, CAST(sum(tf) AS BIGINT) AS freq, split_part(term, ' ', 1) AS x, split_part(term, ' ', 2) AS y, split_part(term, ' ', 3) AS z FROM counts GROUP BY term
), subs AS (
  SELECT freq, x AS sub FROM f WHERE y <> '' UNION ALL SELECT freq, y FROM f WHERE y <> '' AND y <> x
  UNION ALL SELECT freq, z FROM f WHERE z <> '' AND z <> x AND z <> y UNION ALL SELECT freq, x || ' ' || y FROM f WHERE z <> ''
  UNION ALL SELECT freq, y || ' ' || z FROM f WHERE z <> '' AND (y <> x OR z <> y)
), around AS (SELECT sub, sum(freq) / count(*) AS mean FROM subs GROUP BY sub), cv AS (
  SELECT term, freq, round(log2(2 + (y <> '')::INT + (z <> '')::INT) * (freq - coalesce(mean, 0)), 6) AS cvalue FROM f LEFT JOIN around ON sub = term)"""
)


@query(CVALUE_SQL + " SELECT term, freq, cvalue FROM cv")
def c_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.c_values(texts(spark, sf_dir), STOPWORDS)


@query(CVALUE_SQL + f""", z AS (
  SELECT token, round(log10(count(*) * 1e9 / sum(count(*)) OVER ()), 6) AS zipf FROM (SELECT unnest({tokens_sql("text")}) AS token FROM conversations) GROUP BY token
), t AS (SELECT term, freq, unnest(string_split(term, ' ')) AS token FROM cv WHERE cvalue > 0), s AS (
  SELECT term, freq, min(greatest(0.0, 8.0 - coalesce(zipf, 0.0))) AS weirdness FROM t LEFT JOIN z USING (token) GROUP BY term, freq)
SELECT term, round((1 + ln(freq)) * weirdness, 6) AS score FROM s WHERE weirdness > 0 ORDER BY score DESC, term LIMIT 15""")
def contrastive_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Termhood of document terms against the words of conversations as reference."""
    words = table(spark, sf_dir, "conversations").select(F.explode(index.tokenize(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    total = words.agg(F.sum("n")).first()[0] or 1
    reference = words.select("token", F.round(F.log10(F.col("n") * 1e9 / total), 6).alias("zipf"))
    return contrast.strongest(texts(spark, sf_dir), reference, STOPWORDS)
