"""The registered queries of the training-data operators, with their SQL where SQL can express them.

Each callable takes (spark, sf_dir) and applies its operator, with production parameters, to the
whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import conversation_repair, decontaminate, exact_dedup, jaccard_join, language_id, lexical_search, neighbours, packing, quality, secrets, substring_dedup, token_output, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = language_id.train_dictionaries(language_id.training_rows(docs))
    out = language_id.identify(docs, learned)
    return out.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = decontaminate.removal_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.judge(spans)


OP2_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS phrase
  FROM bw, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i)
  WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM win
), places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM dw, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)
), hits AS (
  SELECT doc_id, i, p.n, item FROM places p JOIN win USING (n, phrase)
), words AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM hits, unnest(range(i, i + n)) AS t(k) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), null_ids=True)


OP3_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM d
"""


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.filter_urls(table(spark, sf_dir, "pages"))
    return out.select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = r"""
WITH u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/'
  END AS rule
  FROM u
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(table(spark, sf_dir, "documents")).drop("class")


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i)
  WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT reach.doc_id, b FROM reach JOIN links ON a = other
)
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(other) AS component_id
FROM documents d JOIN reach USING (doc_id) LEFT JOIN n USING (doc_id)
GROUP BY d.doc_id
"""


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def runs_sql(length: int) -> str:
    """Maximal runs of the bytes that strings of ``length`` bytes cover which also start elsewhere."""
    return f"""r{length} AS (SELECT k, i FROM w WHERE s{length} IN (SELECT s{length} FROM w WHERE s{length} IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
), g{length} AS (SELECT k, i, sum(fresh) OVER (PARTITION BY k ORDER BY i) AS g FROM (SELECT k, i, CASE WHEN i <= lag(i) OVER (PARTITION BY k ORDER BY i) + {length} THEN 0 ELSE 1 END AS fresh FROM r{length})
), runs{length} AS (SELECT k, min(i) AS a, max(i) + {length} AS b FROM g{length} GROUP BY k, g)"""


#: Texts are hexadecimal and taken a piece at a time; a string's hash is made of those of its parts of a hundred bytes.
WINDOWS_SQL = """c AS (SELECT k, c * 500 AS begin_, substr(h, 1000 * c + 1, 1198) AS p FROM d, unnest(range(0, length(h) // 1000 + 1)) AS t(c)
), q AS (SELECT k, begin_ + i AS i, hash(substr(p, 2 * i + 1, 200)) AS q FROM c, unnest(range(0, least(500, greatest(length(p) // 2 - 99, 0)))) AS t(i)
), l AS (SELECT k, i, q, lead(q, 100) OVER o AS q1, lead(q, 200) OVER o AS q2, lead(q, 300) OVER o AS q3 FROM q WINDOW o AS (PARTITION BY k ORDER BY i)
), w AS (SELECT k, i, CASE WHEN q2 IS NOT NULL THEN hash(q, q1, q2) END AS s300, CASE WHEN q3 IS NOT NULL THEN hash(q, q1, q2, q3) END AS s400 FROM l)"""
SPACE_SQL = "('20', '09', '0A', '0B', '0C', '0D')"
OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), {WINDOWS_SQL}, {runs_sql(400)}, {runs_sql(300)}, pieces AS (
  SELECT k, a, b, lead(a) OVER (PARTITION BY k ORDER BY a) AS after, row_number() OVER (PARTITION BY k ORDER BY a) AS place FROM runs400
), kept AS (
  SELECT d.k, string_agg(CASE WHEN place = 1 THEN substr(h, 1, 2 * a) ELSE '' END || substr(h, 2 * b + 1, 2 * (coalesce(after, length(h) // 2) - b)), '' ORDER BY a) AS h, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans
  FROM pieces JOIN d USING (k) GROUP BY d.k
), passages AS (
  SELECT k, count(*) AS n FROM runs300 JOIN d USING (k)
  WHERE len(list_filter(range(a, b), lambda i: substr(h, 2 * i + 1, 2) NOT IN {SPACE_SQL} AND (i = 0 OR substr(h, 2 * i - 1, 2) IN {SPACE_SQL}))) > 50 GROUP BY k
)
SELECT doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256, coalesce(n, 0) AS n_passages
FROM d LEFT JOIN kept USING (k) LEFT JOIN passages USING (k)
"""


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(docs))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), q AS (
  SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark
), stats AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS length FROM d WHERE len(w) > 0
), tf AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY k, term
), w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, stats GROUP BY term
), m AS (SELECT k, doc_id, 10 + (90 * len(w) * n_docs) // length AS m FROM d, stats WHERE len(w) > 0
), scored AS (
  SELECT item_id, k, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (k) GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


#: The remainder of CRC-32 is folded bit by bit; the lattice is walked a turn at a time with the best way to each state.
OP13_SQL = r"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), coded AS (
  SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(k, ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) % 20 AS code FROM raw
), hurt AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM coded, unnest(range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS t(copy)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i, rtrim(text, E' \t\n\x0B\f\r') AS bare FROM hurt
), marked AS (
  SELECT conv_id, turn, i, role, text, left(role, 1) AS initial,
         CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
  FROM placed
), counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv_id
), convs AS (
  SELECT o.conv_id, coalesce(n, 0) AS n, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
), puts(s, t, c, a, l) AS (
  VALUES ('e', 'e', 0, '', CAST([] AS VARCHAR[])), ('e', 'u', 2, 'I', ['user:']), ('e', 'a', 4, 'II', ['user:', 'assistant:']), ('s', 's', 0, '', []), ('s', 'u', 2, 'I', ['user:']), ('s', 'a', 4, 'II', ['user:', 'assistant:']),
         ('u', 'u', 0, '', []), ('u', 'a', 2, 'I', ['assistant:']), ('a', 'a', 0, '', []), ('a', 'u', 2, 'I', ['user:'])
), steps(t, z, forced) AS (VALUES ('e', 's', ''), ('e', 'u', 'user'), ('s', 'u', 'user'), ('u', 'a', 'assistant'), ('a', 'u', 'user')
), ways AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, 'e' AS s, {'cost': CAST(0 AS BIGINT), 'audit': '', 'lines': CAST([] AS VARCHAR[])} AS w FROM convs
  UNION ALL
  SELECT conv_id, i, z, min(w) FROM (
    SELECT y.conv_id, m.i, CASE WHEN e = 'D' THEN p.t ELSE z END AS z,
           {'cost': w.cost + c + CASE e WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN e <> 'D' AND fault = 't' THEN 1 ELSE 0 END, 'audit': w.audit || a || e,
            'lines': w.lines || l || CASE e WHEN 'D' THEN CAST([] AS VARCHAR[]) WHEN 'K' THEN [role || ':' || text] ELSE [forced || ':' || text] END} AS w
    FROM ways y JOIN marked m ON y.conv_id IS NOT DISTINCT FROM m.conv_id AND m.i = y.i + 1 JOIN puts p ON p.s = y.s JOIN steps ON steps.t = p.t, unnest(['K', 'R', 'D']) AS edits(e)
    WHERE e = 'D' OR fault NOT IN ('b', 'd') AND (e = 'K' AND initial = z OR e = 'R' AND forced <> '')
  ) GROUP BY conv_id, i, z
), final AS (
  SELECT y.conv_id, min({'cost': w.cost + c, 'audit': w.audit || a, 'lines': w.lines || l}) AS w
  FROM ways y JOIN convs v ON y.conv_id IS NOT DISTINCT FROM v.conv_id AND y.i = v.n JOIN puts p ON p.s = y.s WHERE p.t IN ('e', 'a') GROUP BY y.conv_id
)
SELECT v.conv_id, gaps, blank, duplicate, truncated, illegal, CAST(w.cost AS BIGINT) AS cost, w.audit AS audit, sha256(array_to_string(w.lines, E'\n')) AS repaired_sha256
FROM convs v JOIN final f ON v.conv_id IS NOT DISTINCT FROM f.conv_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_decontaminate": op2_decontaminate,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_url_filters": op4_url_filters,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_token_output": op7_token_output,
    "op8_secret_scan": op8_secret_scan,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_quality": op10_quality,
    "op11_nearest_neighbours": op11_nearest_neighbours,
    "op12_lexical_search": op12_lexical_search,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": OP2_SQL,
    "op3_exact_dedup": OP3_SQL,
    "op5_ngram_jaccard": OP5_SQL,
    "op4_url_filters": OP4_SQL,
    "op6_suffix_array_dedup": OP6_SQL,
    "op12_lexical_search": OP12_SQL,
    "op13_conversation_repair": OP13_SQL,
}
