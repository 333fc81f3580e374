"""Queries: answers, claims and exports, over conversations and order lines that stand for answers and their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import answers as A
from lectern.plans.registry import query, table

# Every turn is an answer that cites; its sources are the lines of an order. In SQL that Spark and the oracle read alike.
TEXT = "coalesce(text, '') || ' [' || (turn % 5) || '] first. So [Source 2, 9] and [2]! Bare end'"
ANSWERS = f"a AS (SELECT conv_id * 100 + turn AS answer, {TEXT} AS text FROM conversations WHERE role = 'assistant')"
PLACE_IN_ORDER = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)"
SOURCES = f"s AS (SELECT l_orderkey * 100 + 1 AS answer, CAST({PLACE_IN_ORDER} AS INT) AS n, CASE WHEN l_partkey % 9 > 0 THEN 'file' || l_suppkey % 4 || '.pdf' END AS filename, CASE WHEN l_partkey % 3 > 0 THEN l_partkey % 50 END AS page, CASE WHEN l_suppkey % 4 > 0 THEN l_quantity / 50 END AS score, 'says ' || l_returnflag || ' ' || l_linestatus AS excerpt FROM lineitem)"
SENTENCES = "string_split(regexp_replace(trim(text), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
CLAIMS = f"""c AS (SELECT answer, i - 1 AS claim, trim(p[i]) AS text FROM (SELECT answer, {SENTENCES} AS p FROM a), unnest(range(1, len(p) + 1)) AS u(i) WHERE trim(p[i]) <> ''
), sc AS (SELECT answer, list(score ORDER BY n) AS sc FROM (SELECT answer, n, score FROM s) GROUP BY answer
), nn AS (SELECT c.*, flatten(list_transform(regexp_extract_all(text, '\\[(?:Source\\s+)?\\d+(?:\\s*(?:,|&|and)\\s*(?:Source\\s+)?\\d+)*\\]'), lambda t: list_transform(regexp_extract_all(t, '\\d+'), lambda d: d::INT))) AS all_, coalesce(sc, []) AS sc FROM c LEFT JOIN sc USING (answer)
), n AS (SELECT *, list_filter(all_, lambda x, i: list_position(all_, x) = i) AS nums, list_filter(all_, lambda x: x BETWEEN 1 AND len(sc)) AS inside FROM nn
), claims AS (SELECT answer, claim, text, array_to_string(nums, ',') AS numbers, nums, CASE WHEN len(inside) = 0 THEN 'unsupported' WHEN list_max(list_transform(inside, lambda x: sc[x])) >= 0.3 THEN 'ok' ELSE 'weak' END AS marker FROM n)"""
ALL = f"WITH {ANSWERS}, {SOURCES}, {CLAIMS}"
BADGE = "CASE marker WHEN 'weak' THEN '⚠ weakly grounded' WHEN 'unsupported' THEN '⚠ unsupported' ELSE '' END"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    return turns.select((F.col("conv_id") * 100 + F.col("turn")).alias("answer"), F.expr(TEXT).alias("text"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, lines = F.col("l_partkey"), table(spark, sf_dir, "lineitem")
    name = F.when(part % 9 > 0, F.concat(F.lit("file"), F.col("l_suppkey") % 4, F.lit(".pdf")))
    score = F.when(F.col("l_suppkey") % 4 > 0, F.col("l_quantity") / 50)
    return lines.select((F.col("l_orderkey") * 100 + 1).alias("answer"), F.expr(PLACE_IN_ORDER).alias("n"), name.alias("filename"), F.when(part % 3 > 0, part % 50).alias("page"), score.alias("score"), F.concat(F.lit("says "), "l_returnflag", F.lit(" "), "l_linestatus").alias("excerpt"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.segment_claims(answers(spark, sf_dir), sources(spark, sf_dir))


@query(f"{ALL} SELECT answer, claim, text, numbers, marker FROM claims")
def segment_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims(spark, sf_dir)


@query(f"{ALL} SELECT c.answer, claim, c.n, filename, page FROM (SELECT answer, claim, unnest(nums) AS n FROM claims) c LEFT JOIN s ON s.answer = c.answer AND s.n = c.n")
def claim_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.claim_citations(claims(spark, sf_dir), sources(spark, sf_dir))


@query(f"""{ALL} SELECT answer, claim, text, numbers, marker, CASE answer % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'edited' ELSE 'pending' END AS decision, CASE WHEN answer % 4 = 1 THEN 'new words' END AS edited FROM claims""")
def adjudicated_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = claims(spark, sf_dir)
    stored = A.record_claims(own.limit(0).withColumn("decision", F.lit("")).withColumn("edited", F.lit("")), own)
    k = F.col("answer") % 4
    to = F.when(k == 0, "accepted").when(k == 1, "edited").when(k == 2, "nonsense")
    return A.adjudicate(stored, own.filter(k < 3).select("answer", "claim", to.alias("to"), F.lit("new words").alias("words")))


@query(f"{ALL} SELECT answer, claim, {BADGE} AS badge FROM claims WHERE marker <> 'ok'")
def flagged_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.flagged_claims(claims(spark, sf_dir))


@query(f"""{ALL} SELECT answer, '**AI interpretation** — the model''s synthesis (review each claim):' || chr(10) || string_agg((claim + 1) || '. ' || text || CASE WHEN numbers <> '' THEN ' [' || replace(numbers, ',', ', ') || ']' ELSE '' END || CASE WHEN marker = 'ok' THEN '' ELSE ' ' || {BADGE} END, chr(10) ORDER BY claim) AS markdown FROM claims GROUP BY answer""")
def interpretation_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.interpretation(claims(spark, sf_dir))


PLACE = "coalesce(filename, 'unknown source') || CASE WHEN page > 0 THEN ', p.' || page ELSE '' END"


@query(f"""WITH {SOURCES}, o AS (SELECT o_orderkey * 100 + 1 AS answer FROM orders UNION SELECT -1), l AS (SELECT answer, string_agg(n || '. *' || {PLACE} || '*' || CASE WHEN score IS NULL THEN '' ELSE printf(' · relevance %.2f', score) END || chr(10) || '   > ' || excerpt, chr(10) ORDER BY n) AS l FROM s GROUP BY answer)
SELECT answer, CASE WHEN l IS NULL THEN '**Evidence** — no sources retrieved.' ELSE '**Evidence** — what your sources say:' || chr(10) || l END AS markdown FROM o LEFT JOIN l USING (answer)""")
def evidence_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 100 + 1).alias("answer")).unionByName(spark.createDataFrame([(-1,)], "answer long"))
    return A.evidence(own, sources(spark, sf_dir))


@query(f"WITH {SOURCES} SELECT answer, n, '- [' || n || '] ' || coalesce(filename, '?') || CASE WHEN page > 0 THEN ', p.' || page ELSE '' END || CASE WHEN n % 2 = 0 THEN ' 🖼' ELSE '' END AS line, substr(excerpt, 1, 300) AS excerpt, substr(excerpt, 1, 800) AS preview, round(score, 4) AS score FROM s")
def answer_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sources(spark, sf_dir)
    line = A.source_line(F.col("n"), F.col("filename"), F.col("page"), F.col("n") % 2 == 0)
    return A.source_views(rows).join(rows.select("answer", "n", line.alias("line")), ["answer", "n"])


@query(f"WITH {SOURCES}, f AS (SELECT answer, filename, min(n) AS n FROM s WHERE filename IS NOT NULL GROUP BY 1, 2) SELECT answer, CAST(row_number() OVER (PARTITION BY answer ORDER BY n) - 1 AS INT) AS place, filename FROM f")
def cited_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.distinct_names(sources(spark, sf_dir))


@query(f"WITH {SOURCES} SELECT q.answer, 3 AS n, filename, CASE WHEN s.answer IS NULL THEN 404 ELSE 200 END AS status FROM (SELECT o_orderkey * 100 + 1 AS answer FROM orders) q LEFT JOIN s ON s.answer = q.answer AND s.n = 3")
def nth_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 100 + 1).alias("answer"), F.lit(3).alias("n"))
    return A.nth_source(sources(spark, sf_dir), asked)


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 2 + l_suppkey % 3 // 2 + l_linenumber % 2 > 0 THEN '⚠ ' || concat_ws('; ', CASE WHEN l_partkey % 2 = 1 THEN 'weak match' END, CASE WHEN l_suppkey % 3 = 2 THEN 'sources hard to tell apart' END, CASE WHEN l_linenumber % 2 = 1 THEN 'few sources' END) || ' — interpret with caution.' END AS banner FROM lineitem")
def answer_banners(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = A.banner(F.col("l_partkey") % 2 == 1, F.col("l_suppkey") % 3 == 2, F.col("l_linenumber") % 2 == 1)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", shown.alias("banner"))


ROLE = "upper(role[1]) || role[2:]"


@query(f"SELECT conv_id, string_agg('## Turn ' || turn || chr(10) || '**' || {ROLE} || ':** ' || coalesce(nullif(trim(text), ''), '_(no answer)_'), chr(10) || chr(10) ORDER BY turn, role) AS markdown FROM conversations GROUP BY conv_id")
def conversation_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.conversation_markdown(table(spark, sf_dir, "conversations"))


@query(f"WITH o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS k FROM conversations) SELECT conv_id, string_agg({ROLE} || ': ' || coalesce(text, ''), chr(10) ORDER BY k DESC) AS history FROM o WHERE k <= 6 GROUP BY conv_id")
def conversation_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.history(table(spark, sf_dir, "conversations"))


@query("""WITH c AS (SELECT DISTINCT conv_id FROM conversations) SELECT conv_id, conv_id % 2 = 0 AND conv_id % 3 = 0 AS pinned, conv_id % 2 = 0 AS archived, conv_id % 5 = 0 AS deleted, CASE WHEN conv_id % 5 = 0 THEN CASE WHEN conv_id % 2 = 0 THEN 'New' END WHEN conv_id % 2 = 0 THEN 'Old' END AS title FROM c WHERE conv_id % 2 = 0 OR conv_id % 5 = 0""")
def conversation_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, k, no = table(spark, sf_dir, "conversations").select("conv_id").distinct(), F.col("conv_id"), F.lit(None).cast("boolean")
    stored = ids.filter(k % 2 == 0).select("conv_id", (k % 3 == 0).alias("pinned"), F.lit(True).alias("archived"), F.lit(False).alias("deleted"), F.lit("Old").alias("title"))
    edits = ids.filter(k % 5 == 0).select("conv_id", no.alias("pinned"), no.alias("archived"), F.lit(True).alias("deleted"), F.when(k % 2 == 0, " New ").otherwise(" ").alias("title"))
    return A.set_flags(stored, edits)


@query(f"WITH {SOURCES} SELECT answer, string_agg('[Source ' || n || '] ' || coalesce(filename, '?') || chr(10) || excerpt, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n) AS prompt FROM s GROUP BY answer")
def prompt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.prompt_block(sources(spark, sf_dir))
