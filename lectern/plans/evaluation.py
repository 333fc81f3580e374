"""Queries: scorers, reviews, runs and retrieval signals, over orders and conversations that stand for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import evaluation as E
from lectern.plans.corpus import SCORES_SQL, scores
from lectern.plans.registry import query, table

TAGS = ("missing", "wrong", "vague")
REVIEWS = "r AS (SELECT o_custkey AS answer, o_orderkey % 5 AS version, CASE o_orderkey % 7 WHEN 0 THEN 'missing' WHEN 1 THEN ' Wrong' WHEN 2 THEN 'vague' WHEN 3 THEN 'odd' ELSE 'none' END AS said, o_orderkey % 13 = 0 AND o_orderkey % 7 <> 1 AS golden FROM orders), t AS (SELECT *, CASE WHEN lower(trim(said)) IN ('missing', 'wrong', 'vague') THEN lower(trim(said)) ELSE 'none' END AS tag FROM r)"


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    said = F.when(k % 7 == 0, "missing").when(k % 7 == 1, " Wrong").when(k % 7 == 2, "vague").when(k % 7 == 3, "odd").otherwise("none")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("answer"), (k % 5).alias("version"), E.coerce_tag(said, TAGS).alias("tag"), ((k % 13 == 0) & (k % 7 != 1)).alias("golden"))


TAG_SQL = "stats AS (SELECT tag, count(*) AS n, count(DISTINCT answer) AS n_answers, round(count(*) / (SELECT count(*) FROM t), 6) AS share FROM t GROUP BY tag), a AS (SELECT *, tag <> 'none' AND n >= 10 AND n_answers >= 5 AS actionable FROM stats)"


@query(f"WITH {REVIEWS}, {TAG_SQL} SELECT * FROM a")
def tag_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.tag_stats(reviews(spark, sf_dir))


@query(f"WITH {REVIEWS}, {TAG_SQL}, g AS (SELECT tag, count(*) AS g FROM t WHERE golden GROUP BY tag) SELECT a.tag, CASE WHEN coalesce(g, 0) / (SELECT count(*) FROM t WHERE golden) >= 0.14 THEN 'reviewer_bias' ELSE 'system_fault' END AS verdict FROM a LEFT JOIN g ON g.tag = a.tag WHERE actionable")
def bias_or_fault(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reviews(spark, sf_dir)
    return E.bias_or_fault(E.tag_stats(rows), rows.filter("golden"), 0.14)


@query(f"WITH {REVIEWS}, c AS (SELECT version, tag, count(*) AS n FROM t WHERE tag <> 'none' GROUP BY 1, 2) SELECT version, tag, n FROM c QUALIFY row_number() OVER (PARTITION BY version ORDER BY n DESC, tag) = 1")
def dominant_fault(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.dominant_fault(reviews(spark, sf_dir))


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_partkey % 6 END AS a, l_suppkey % 4 + 2 AS b, 1 + l_orderkey % 5 AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN a BETWEEN 1 AND 5 AND c BETWEEN 1 AND 5 THEN round((a + b + c) / 3, 6) END AS mean, CASE WHEN least(a, b, c) <= 2 THEN 'fail' WHEN least(a, b, c) = 3 THEN 'concern' ELSE 'pass' END AS verdict, least(a, b, c) AS low FROM m""")
def review_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c = F.when(F.col("l_partkey") % 11 != 0, F.col("l_partkey") % 6), F.col("l_suppkey") % 4 + 2, 1 + F.col("l_orderkey") % 5
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", E.judge_mean(a, b, c).alias("mean"), E.verdict_of(a, b, c).alias("verdict"), E.weakest(a, b, c).alias("low"))


@query("""WITH c AS (SELECT conv_id, turn, role, string_split(text, ' ') AS w, text FROM conversations WHERE text IS NOT NULL), x AS (SELECT *, [lower(w[1]), 'zzz', w[2]] AS e, CASE WHEN turn % 2 = 0 THEN lower(text) || ' ' ELSE w[1] END AS expected FROM c)
SELECT conv_id, turn, role, CASE WHEN turn % 5 = 4 THEN NULL WHEN lower(trim(expected)) = lower(trim(text)) THEN 1.0 ELSE 0.0 END AS exact, round(len(list_filter(e, lambda v: contains(lower(text), lower(v)))) / len(list_filter(e, lambda v: TRUE)), 6) AS contained,
  len(list_filter(w[1:4], lambda f: len(list_filter(e, lambda v: contains(lower(f), lower(v)) OR contains(lower(v), lower(f)))) = 0)) AS n_extra FROM x WHERE len(w) > 1""")
def answer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, text = F.split("text", " "), F.col("text")
    rows = table(spark, sf_dir, "conversations").filter(F.size(w) > 1)
    expected = F.when(F.col("turn") % 5 == 4, None).when(F.col("turn") % 2 == 0, F.concat(F.lower(text), F.lit(" "))).otherwise(w[0])
    names = F.array(F.lower(w[0]), F.lit("zzz"), w[1])
    return rows.select("conv_id", "turn", "role", E.exact_match(expected, text).alias("exact"), F.round(E.contains_all(names, text), 6).alias("contained"), F.size(E.extra_names(names, F.slice(w, 1, 4))).cast("long").alias("n_extra"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN CASE WHEN o_custkey % 10 IN (o_orderkey % 10, 3) THEN 1.0 ELSE 0.0 END WHEN o_orderkey % 4 = 1 THEN CASE WHEN o_orderkey % 3 = 1 THEN 1.0 ELSE 0.0 END END AS found FROM orders""")
def figure_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    figure, name, page = F.when(k % 4 == 0, F.col("o_custkey") % 10), F.when(k % 4 == 1, "a.pdf"), F.when(k % 4 == 1, k % 3)
    found = F.array(F.struct((k % 10).alias("figure"), F.lit("b.pdf").alias("filename"), F.lit(1).cast("long").alias("page")), F.struct(F.lit(3).cast("long").alias("figure"), F.lit("a.pdf").alias("filename"), F.lit(1).cast("long").alias("page")))
    return table(spark, sf_dir, "orders").select("o_orderkey", E.figure_found(figure, name, page, found).alias("found"))


RUNS_SQL = "runs AS (SELECT o_custkey % 40 AS run, count(DISTINCT o_orderkey) AS n_cases, count(*) FILTER (o_orderkey % 9 = 0) AS n_failed, CAST(min(o_orderdate) AS VARCHAR) AS started, CAST(max(o_orderdate) AS VARCHAR) AS finished FROM orders GROUP BY 1)"


@query(f"WITH {RUNS_SQL} SELECT * FROM runs ORDER BY started DESC, run LIMIT 10")
def latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("run"), F.col("o_orderkey").alias("case"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("at"), F.when(F.col("o_orderkey") % 9 == 0, "failed").alias("error"))
    return E.latest_runs(E.run_rows(rows), 10)


@query(f'WITH {SCORES_SQL} SELECT "case", scorer, value, value IS NULL AS skipped FROM scores WHERE run = 1')
def case_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.case_scores(scores(spark, sf_dir), 1)


@query(f"""WITH {SCORES_SQL} SELECT x."case", x.scorer, x.value AS a, y.value AS b, y.value - x.value AS delta FROM scores x JOIN scores y ON x."case" = y."case" AND x.scorer = y.scorer AND x.run = 0 AND y.run = 2
ORDER BY abs(y.value - x.value) DESC NULLS LAST, x."case", x.scorer LIMIT 20""")
def largest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.largest_changes(E.diff_runs(scores(spark, sf_dir), 0, 2), 20)


@query("""WITH a AS (SELECT p_partkey AS arm, 'k=' || p_size % 10 || chr(10) || 'model=' || substr(p_brand, 1, 7) AS s FROM part), f AS (SELECT s, min(arm) AS same_as FROM a GROUP BY s)
SELECT arm, same_as, substr(sha256(s), 1, 12) AS version FROM a JOIN f USING (s) WHERE arm <> same_as""")
def duplicate_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = F.create_map(F.lit("model"), F.substring("p_brand", 1, 7), F.lit("k"), (F.col("p_size") % 10).cast("string"))
    arms = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("arm"), settings.alias("settings"))
    return E.duplicate_arms(arms).join(arms.select("arm", E.settings_hash(F.col("settings")).alias("version")), "arm")


@query("WITH p AS (SELECT l_orderkey AS query, l_suppkey % 4 AS source, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT query, max(n) AS top, max(n) >= 3 AS crowded FROM p GROUP BY query")
def crowding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.crowding(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query"), (F.col("l_suppkey") % 4).alias("source")))


@query("""WITH s AS (SELECT l_orderkey AS answer, l_suppkey % 4 AS source, CASE WHEN l_partkey % 5 > 0 THEN l_partkey % 17 / 20 END AS score FROM lineitem), g AS (SELECT answer, list(score ORDER BY score DESC) FILTER (score IS NOT NULL) AS b, count(DISTINCT source) AS n FROM s GROUP BY answer)
SELECT answer, coalesce(b[1], 0) < 0.3 AS weak, coalesce(b[1] - b[3] < 0.051 AND b[1] < 0.7, FALSE) AS clustered, n <= 2 AS few_sources FROM g""")
def confidence_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.when(F.col("l_partkey") % 5 > 0, F.col("l_partkey") % 17 / 20)
    return E.confidence_signals(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("answer"), (F.col("l_suppkey") % 4).alias("source"), score.alias("score")), span=0.051)
