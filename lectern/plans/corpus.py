"""Queries: library, evaluation, graph, taxonomy, text and vector operators on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import html
from lectern.functions.text import cited_numbers, doc_hash, edit_similarity, health, slugify, split_sentences
from lectern.functions.vectors import normalized
from lectern.operators import evaluation, graph, index, keywords, library, retrieve
from lectern.operators.scratch import materialize, scratch_path
from lectern.plans.registry import query, table, texts
from lectern.plans.search import STOPWORDS, TERMS_SQL, tokens_sql
from lectern.streaming.ingest import ingest_available
from lectern.streaming.ingest import library as taken

HASH_SQL = "substr(sha256(coalesce(text, '')), 1, 16)"


@query(f"SELECT {HASH_SQL} AS digest, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.duplicates(table(spark, sf_dir, "documents"), "doc_id", doc_hash(F.coalesce("text", F.lit(""))))


@query("SELECT lang, source, GROUPING(lang, source) AS level, count(*) AS n_docs, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS total FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def library_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.summary(table(spark, sf_dir, "documents"), "lang", "source", size="n_chars")


STATUS_SQL = """stored AS (SELECT doc_id, source, n_chars AS chunks FROM documents WHERE doc_id % 3 <> 0
), fresh AS (SELECT doc_id, upper(source) AS source, n_chars + 1 AS chunks FROM documents WHERE doc_id % 2 = 0)"""


def stored_and_fresh(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    stored = docs.filter(F.col("doc_id") % 3 != 0).select("doc_id", "source", F.col("n_chars").alias("chunks"))
    return stored, docs.filter(F.col("doc_id") % 2 == 0).select("doc_id", F.upper("source").alias("source"), (F.col("n_chars") + 1).alias("chunks"))


@query(f"""WITH {STATUS_SQL}
SELECT coalesce(s.doc_id, f.doc_id) AS doc_id, CASE WHEN s.doc_id IS NULL THEN f.source ELSE s.source END AS source, coalesce(f.chunks, s.chunks) AS chunks,
       CASE WHEN s.doc_id IS NULL THEN 'extract' WHEN f.doc_id IS NULL THEN 'kept' ELSE 'reextract' END AS event
FROM stored s FULL JOIN fresh f ON s.doc_id = f.doc_id""")
def upsert_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.upsert(*stored_and_fresh(spark, sf_dir), "doc_id", ["chunks"])


@query(f"""WITH h AS (SELECT doc_id, {HASH_SQL} AS digest FROM documents
), stored AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE digest END AS digest FROM h), now AS (SELECT * FROM h WHERE doc_id % 4 <> 0)
SELECT s.doc_id, s.digest, CASE WHEN n.doc_id IS NULL THEN 'gone' WHEN n.digest <> s.digest THEN 'stale' ELSE 'kept' END AS status
FROM stored s LEFT JOIN now n ON s.doc_id = n.doc_id""")
def orphan_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = table(spark, sf_dir, "documents").select("doc_id", doc_hash(F.coalesce("text", F.lit(""))).alias("digest"))
    stored = now.withColumn("digest", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("digest")))
    return library.classify_stored(stored, now.filter(F.col("doc_id") % 4 != 0), "doc_id", "digest")


@query("""WITH f AS (
  SELECT conv_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM conversations
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) = 1
), g AS (SELECT conv_id, count(*) AS n_turns, max(turn) AS last_turn FROM conversations GROUP BY conv_id)
SELECT conv_id, n_turns, last_turn, CASE WHEN t = '' THEN '(untitled)' WHEN length(t) > 80 THEN rtrim(substr(t, 1, 79)) || '…' ELSE t END AS title
FROM g JOIN f USING (conv_id) ORDER BY n_turns DESC, conv_id LIMIT 50""")
def conversations_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.conversations(table(spark, sf_dir, "conversations"), 50)


@query("SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS place FROM conversations QUALIFY place <= 6")
def last6_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.last_turns(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), 6)


@query("""WITH s AS (
  SELECT conv_id, list_filter(list_transform(string_split(regexp_replace(trim(coalesce(text, '')), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS p FROM conversations)
SELECT conv_id, CAST(sum(len(p)) AS BIGINT) AS n_sentences, CAST(max(list_max(list_transform(p, lambda x: length(x)))) AS BIGINT) AS longest FROM s GROUP BY conv_id""")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "conversations").select("conv_id", split_sentences(F.col("text")).alias("p"))
    return parts.groupBy("conv_id").agg(F.sum(F.size("p")).alias("n_sentences"), F.max(F.array_max(F.transform("p", lambda s: F.length(s).cast("long")))).alias("longest"))


@query("""WITH c AS (
  SELECT conv_id, turn, role, list_transform(regexp_extract_all(coalesce(text, '') || ' [' || (turn + 1) || '] and [Source 2, 9]', '\\[(?:Source\\s+)?\\d+(?:\\s*(?:,|&|and)\\s*(?:Source\\s+)?\\d+)*\\]'), lambda t: list_transform(regexp_extract_all(t, '\\d+'), lambda d: d::INT)) AS n FROM conversations
), f AS (SELECT conv_id, turn, role, flatten(n) AS n FROM c)
SELECT conv_id, turn, role, len(n) AS n_cited, len(list_distinct(list_filter(n, lambda x: x BETWEEN 1 AND 3))) AS n_valid, len(list_distinct(list_filter(n, lambda x: NOT x BETWEEN 1 AND 3))) AS n_outside FROM f""")
def citation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.concat(F.coalesce("text", F.lit("")), F.lit(" ["), (F.col("turn") + 1).cast("string"), F.lit("] and [Source 2, 9]"))
    got = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", cited_numbers(answer).alias("n"))

    def distinct(inside: bool):
        return F.size(F.array_distinct(F.filter("n", lambda x: x.between(1, 3) == inside))).cast("long")

    return got.select("conv_id", "turn", "role", F.size("n").cast("long").alias("n_cited"), distinct(True).alias("n_valid"), distinct(False).alias("n_outside"))


SCORES_SQL = """scores AS (
  SELECT doc_id % 3 AS run, doc_id // 3 AS "case", 'quality' AS scorer, CASE WHEN doc_id % 7 <> 0 THEN CAST(quality AS DOUBLE) END AS value FROM labels
  UNION ALL SELECT doc_id % 3, doc_id // 3, 'toxic', CASE WHEN doc_id % 7 <> 0 THEN CAST(toxic AS DOUBLE) END FROM labels)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as scores: the run is doc_id % 3, and every seventh document was skipped."""
    labels = table(spark, sf_dir, "labels")
    value = [F.when(F.col("doc_id") % 7 != 0, F.col(c).cast("double")) for c in ("quality", "toxic")]
    long = [labels.select((F.col("doc_id") % 3).alias("run"), F.floor(F.col("doc_id") / 3).cast("long").alias("case"), F.lit(c).alias("scorer"), v.alias("value")) for c, v in zip(("quality", "toxic"), value, strict=True)]
    return long[0].unionByName(long[1])


@query(f"WITH {SCORES_SQL} SELECT run, scorer, round(avg(value), 6) AS mean, count(value) AS n_scored, count(*) - count(value) AS n_skipped FROM scores GROUP BY run, scorer")
def eval_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.scorer_stats(scores(spark, sf_dir))


@query(f"""WITH {SCORES_SQL}, r AS (SELECT scorer, run, avg(value) AS m FROM scores GROUP BY scorer, run
), t AS (SELECT scorer, count(m) AS n_runs, round(avg(m), 6) AS trial_mean, round(stddev_samp(m), 6) AS trial_std FROM r GROUP BY scorer
), p AS (SELECT scorer, round(avg(value), 6) AS pooled_mean, round(stddev_samp(value), 6) AS pooled_std, count(value) AS n_scored FROM scores GROUP BY scorer)
SELECT * FROM t JOIN p USING (scorer)""")
def eval_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.aggregate_runs(scores(spark, sf_dir))


@query(f'WITH {SCORES_SQL} SELECT scorer, "case", count(value) AS n_scored, count(*) - count(value) AS n_skipped FROM scores GROUP BY scorer, "case" HAVING count(value) > 0 AND count(*) > count(value)')
def eval_flaky(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.flaky_cases(scores(spark, sf_dir))


@query(f"""WITH {SCORES_SQL} SELECT x."case", x.scorer, x.value AS a, y.value AS b, y.value - x.value AS delta
FROM scores x JOIN scores y ON x."case" = y."case" AND x.scorer = y.scorer AND x.run = 0 AND y.run = 1""")
def eval_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.diff_runs(scores(spark, sf_dir), 0, 1)


@query("""WITH d AS (
  SELECT label, i AS dim, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(i) GROUP BY label, i
), n AS (SELECT label, sqrt(sum(m * m)) AS norm FROM d GROUP BY label)
SELECT d.label, dim, round(CASE WHEN norm > 0 THEN m / norm ELSE m END, 5) AS value FROM d JOIN n ON d.label IS NOT DISTINCT FROM n.label""")
def mean_pool_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means are taken for each dimension before the shuffle; only one short vector for each label is gathered."""
    parts = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    means = parts.groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    vectors = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda x: x["m"]).alias("v"))
    return vectors.select("label", F.posexplode(normalized(F.col("v"))).alias("dim", "value")).select("label", (F.col("dim") + 1).cast("long").alias("dim"), F.round("value", 5).alias("value"))


KNN_SQL = """sims AS (
  SELECT q.vec_id AS query, v.vec_id AS doc,
         round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]))), 5) AS score
  FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id AND q.vec_id % 50 = 0
), knn AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM sims QUALIFY rank <= 10)"""


def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of each query vector (identifiers divisible by 50) among all vectors."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return retrieve.dense_rank(vectors, vectors.filter(F.col("id") % 50 == 0), 10)


@query(f"WITH {KNN_SQL} SELECT query, doc, score, rank FROM knn WHERE score >= 0.2")
def knn_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn(spark, sf_dir).filter("score >= 0.2")


# Orders and parts that a line of fifty pieces joins; parts are numbered on from ten billion.
GRAPH_SQL = """e AS (SELECT l_orderkey AS a, l_partkey + 10000000000 AS b FROM lineitem WHERE l_quantity = 50 UNION SELECT l_partkey + 10000000000, l_orderkey FROM lineitem WHERE l_quantity = 50
), nodes AS (SELECT o_orderkey AS node FROM orders UNION ALL SELECT p_partkey + 10000000000 FROM part)"""


def nodes_and_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A graph that is whole by itself: all orders and parts are nodes."""
    part = F.col("p_partkey") + 10_000_000_000
    nodes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node")).unionByName(table(spark, sf_dir, "part").select(part.alias("node")))
    return nodes, table(spark, sf_dir, "lineitem").filter("l_quantity = 50").select(F.col("l_orderkey").alias("a"), (F.col("l_partkey") + 10_000_000_000).alias("b"))


@query(f"""WITH RECURSIVE {GRAPH_SQL}, r AS (SELECT node, node AS other FROM nodes UNION SELECT node, b FROM r JOIN e ON a = other)
SELECT node, min(other) AS component FROM r GROUP BY node""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(*nodes_and_edges(spark, sf_dir))


DEGREE_SQL = f"""{GRAPH_SQL}, d AS (SELECT node, count(b) AS degree FROM nodes LEFT JOIN e ON a = node GROUP BY node
), v AS (SELECT list_sort(list(degree)) AS v, count(*) AS n FROM d WHERE degree > 0
), q AS (SELECT v, n, 0.25 * (n + 1) AS pos, CAST(least(greatest(floor(0.25 * (n + 1)), 1), n - 1) AS INT) AS low FROM v
), m AS (SELECT CAST(CASE WHEN n < 4 THEN 1 ELSE greatest(1, round_even(v[low] + (pos - low) * (v[low + 1] - v[low]), 0)) END AS BIGINT) AS min_degree FROM q)"""


@query(f"WITH {DEGREE_SQL} SELECT node, degree, CASE WHEN degree = 0 THEN 'isolated' WHEN degree < min_degree THEN 'under_connected' ELSE 'connected' END AS gap FROM d, m")
def degree_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    degree = graph.degrees(*nodes_and_edges(spark, sf_dir))
    gap = F.when(F.col("degree") == 0, "isolated").when(F.col("degree") < F.col("min_degree"), "under_connected").otherwise("connected")
    return degree.crossJoin(F.broadcast(graph.min_degree(degree))).select("node", "degree", gap.alias("gap"))


@query(f"WITH {DEGREE_SQL} SELECT min_degree FROM m")
def min_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.min_degree(graph.degrees(*nodes_and_edges(spark, sf_dir)))


@query(f"""WITH {GRAPH_SQL}, n0 AS (SELECT DISTINCT a AS node FROM e WHERE a < 10000000000 AND a % 10 = 1
), n1 AS (SELECT b AS node FROM e WHERE a IN (SELECT node FROM n0)), n2 AS (SELECT b AS node FROM e WHERE a IN (SELECT node FROM n1)
), every AS (SELECT node, 0 AS distance FROM n0 UNION ALL SELECT node, 1 FROM n1 UNION ALL SELECT node, 2 FROM n2)
SELECT node, min(distance) AS distance FROM every GROUP BY node""")
def bfs_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies within two edges of a stated set of orders."""
    _, edges = nodes_and_edges(spark, sf_dir)
    return graph.neighbourhood(edges, edges.filter("a % 10 = 1").select(F.col("a").alias("node")), 2)


VOCABULARY_SQL = f"""{TERMS_SQL}, b AS (SELECT term, count(*) AS df, sum(tf) AS tf FROM counts GROUP BY term
), vocabulary AS (
  SELECT term FROM b WHERE NOT contains(term, ' ') AND df BETWEEN 2 AND (SELECT greatest(2, CAST(floor(0.7 * count(*)) AS BIGINT)) FROM documents)
  ORDER BY round(df * (1 + ln(tf)), 6) DESC, term LIMIT 40
), presence AS (SELECT term, doc, tf FROM counts JOIN vocabulary USING (term))"""


def presence_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """term, doc, tf for the 40 best single words of the corpus band, a fixed vocabulary; only words of it leave their documents."""
    docs = texts(spark, sf_dir)
    best = keywords.band_of(keywords.term_totals(docs, STOPWORDS, ngram_max=1), table(spark, sf_dir, "documents").count(), 40)
    words = [r["term"] for r in best.select("term").collect()]
    return materialize(keywords.counts_of(docs, words, STOPWORDS).select("term", "doc", "tf"), "presence")


@query(f"WITH {VOCABULARY_SQL} SELECT term, count(*) AS n_docs, CAST(sum(tf) AS BIGINT) AS mentions FROM presence GROUP BY term")
def presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presence_table(spark, sf_dir).groupBy("term").agg(F.count("*").alias("n_docs"), F.sum("tf").alias("mentions"))


@query(f"""WITH {VOCABULARY_SQL}
SELECT x.term AS a, y.term AS b, count(*) AS n, round(1 + 0.5 * (1 - 1 / (1 + count(*))), 6) AS weight
FROM presence x JOIN presence y ON x.doc = y.doc AND x.term < y.term GROUP BY x.term, y.term HAVING count(*) >= 2""")
def cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_of(presence_table(spark, sf_dir))


def pairs_of(presence: DataFrame) -> DataFrame:
    """Pairs of the fixed vocabulary within each document: at most 780 a document, and none of documents."""
    held = presence.groupBy("doc").agg(F.array_sort(F.collect_set("term")).alias("t"))
    pairs = held.select(F.posexplode("t").alias("i", "a"), "t").select("a", F.explode(F.expr("slice(t, i + 2, size(t))")).alias("b"))
    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n >= 2")
    return counted.withColumn("weight", graph.edge_weight(F.lit(1.0), F.lit(0.0), F.col("n")))


FIELDS_SQL = """edges AS (
  SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation
  UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region)"""


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    return nation.unionByName(table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("child"), F.lit("world").alias("parent")))


@query(f"""WITH RECURSIVE {FIELDS_SQL}, up AS (SELECT child AS node, parent AS ancestor FROM edges UNION SELECT node, parent FROM up JOIN edges ON child = ancestor
), placed AS (SELECT c_custkey, 'n' || c_nationkey AS node FROM customer
), every AS (SELECT node AS field, c_custkey FROM placed UNION SELECT ancestor, c_custkey FROM placed JOIN up USING (node))
SELECT field, count(DISTINCT c_custkey) AS n_rolled_up FROM every GROUP BY field""")
def taxonomy_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts climb, not members: each node's own count is summed over its distinct descendants."""
    direct = table(spark, sf_dir, "customer").groupBy(F.concat(F.lit("n"), "c_nationkey").alias("node")).agg(F.count_distinct("c_custkey").alias("n"))
    up = graph.ancestors(fields(spark, sf_dir)).unionByName(direct.select("node", F.col("node").alias("ancestor")))
    return direct.join(up, "node").groupBy(F.col("ancestor").alias("field")).agg(F.sum("n").alias("n_rolled_up"))


@query(f"WITH {FIELDS_SQL} SELECT DISTINCT parent AS field FROM edges WHERE parent NOT IN (SELECT child FROM edges)")
def taxonomy_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = fields(spark, sf_dir)
    return edges.select(F.col("parent").alias("field")).distinct().join(edges.select(F.col("child").alias("field")), "field", "left_anti")


@query("""SELECT p_partkey, round(1.0 - levenshtein(lower(p_name), lower(p_type)) / greatest(length(p_name), length(p_type)), 6) AS similarity,
       regexp_replace(regexp_replace(lower(p_brand || ' ' || p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part""")
def name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    close = edit_similarity(F.lower("p_name"), F.lower("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(close, 6).alias("similarity"), slugify(F.concat_ws(" ", "p_brand", "p_name")).alias("slug"))


@query("""WITH s AS (
  SELECT doc_id, CAST(ceil(n_chars / 400.0) AS BIGINT) AS k, least(n_chars, 400) AS mean, greatest(1, CAST(ceil(n_chars / 3000.0) AS BIGINT)) AS pages FROM documents
), p AS (SELECT doc_id, k, CASE WHEN k <= 1 THEN 0 ELSE greatest(0, 100 - (
    CASE WHEN k <= 3 THEN 50 ELSE 0 END + CASE WHEN k / pages < 2 OR k / pages > 15 THEN 30 ELSE 0 END
    + CASE WHEN mean < 100 THEN 40 WHEN mean < 300 THEN 25 ELSE 0 END + 15)) END AS score FROM s)
SELECT doc_id, CAST(score AS INT) AS score, CASE WHEN score >= 75 THEN 'healthy' WHEN score >= 40 THEN 'marginal' ELSE 'broken' END AS grade FROM p""")
def document_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    pages = F.greatest(F.lit(1), F.ceil(n / 3000).cast("long"))
    grade = health(F.ceil(n / 400).cast("long"), F.least(n, F.lit(400)), pages, F.lit(0.0), F.lit("md"), F.lit(0.0))
    return table(spark, sf_dir, "documents").select("doc_id", grade.alias("h")).select("doc_id", "h.*")


def steps_sql(column: str) -> str:
    out = f"coalesce({column}, '')"
    for pattern, becomes in html.STEPS:
        quoted = [x.replace("'", "''") for x in (pattern, becomes)]
        out = f"regexp_replace({out}, '{quoted[0]}', '{quoted[1]}', 'g')"
    return out


@query(f"SELECT page_id, {steps_sql('html')} AS markdown FROM pages")
def html_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html.to_markdown(F.col("html")).alias("markdown"))


@query(f"SELECT token, count(*) AS n, count(DISTINCT conv_id) AS n_convs FROM (SELECT conv_id, unnest({tokens_sql('text')}) AS token FROM conversations) GROUP BY token")
def conversation_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "conversations").select("conv_id", F.explode(index.tokenize(F.col("text"))).alias("token"))
    each = tokens.groupBy("token", "conv_id").agg(F.count("*").alias("k"))
    return each.groupBy("token").agg(F.sum("k").alias("n"), F.count("*").alias("n_convs"))


@query(f"SELECT DISTINCT {HASH_SQL} AS doc_hash FROM documents")
def ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of the incremental ingest over the same files: the second finds nothing new."""
    where = scratch_path(spark, "ingest")
    schema = table(spark, sf_dir, "documents").schema
    for _ in range(2):
        ingest_available(spark, f"{sf_dir}/documents*.parquet", schema, f"{where}/table", f"{where}/log")
    return taken(spark, f"{where}/table").select("doc_hash")
