"""Queries: the concept graph over the lines of the documents, with a stated vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import concepts, vector_index
from lectern.operators.scratch import materialize
from lectern.plans.registry import query, table, texts
from lectern.plans.search import FOLD

# The stated vocabulary of the queries: number, label, aliases, documents.
VOCABULARY = [(1, " The", ["das", "le"], 9), (2, "and", ["und", "et"], 9), (3, "of the", [], 4), (4, "In", ["of"], 2), (5, "that,", ["que"], 7), (6, "Straße", ["en"], 1), (7, "was", ["la", "los"], 0), (8, "none-such", [], 0), (9, "is", ["der", "The"], 3)]
ROWS_SQL = "vocabulary AS (SELECT * FROM (VALUES " + ", ".join(f"({c}, '{x}', CAST({a!r} AS VARCHAR[]), {n})" for c, x, a, n in VOCABULARY) + ") AS t(concept, label, aliases, n_docs))"
PRESENCE_SQL = f"""{ROWS_SQL}, lines AS (SELECT doc_id AS doc, i - 1 AS i, {FOLD.format("l[i]")} AS low FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), unnest(range(1, len(l) + 1)) AS u(i)
), toks AS (SELECT doc || ':p' || i AS passage, doc, regexp_extract_all(low, '[a-z0-9]+|[^a-z0-9]') AS w FROM lines
), forms AS (SELECT DISTINCT concept, {FOLD.format("trim(form)")} AS form, regexp_extract_all({FOLD.format("trim(form)")}, '[a-z0-9]+|[^a-z0-9]') AS f FROM (SELECT concept, unnest(list_prepend(label, aliases)) AS form FROM vocabulary)
), presence AS (SELECT concept, doc, passage, count(*) AS n FROM (SELECT doc, passage, i, w, w[i] AS t FROM toks, unnest(range(1, len(w) + 1)) AS u(i)) x JOIN forms ON t = f[1] AND w[i:i + len(f) - 1] = f GROUP BY ALL)"""


def vocabulary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VOCABULARY, "concept long, label string, aliases array<string>, n_docs long")


def presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = texts(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("i", "text"))
    passages = lines.select(F.concat("doc", F.lit(":p"), "i").alias("passage"), "doc", "text")
    return materialize(concepts.match_presence(vocabulary(spark), passages), "presence")


@query(f"WITH {PRESENCE_SQL} SELECT concept, doc, passage, n FROM presence")
def concept_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presence(spark, sf_dir)


@query(f"WITH {PRESENCE_SQL} SELECT concept, doc, CAST(sum(n) AS BIGINT) AS n_mentions, count(*) AS n_passages FROM presence GROUP BY ALL")
def presence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concepts.presence_rows(presence(spark, sf_dir))


EDGES_SQL = f"""{PRESENCE_SQL}, edges AS (SELECT x.concept AS a, y.concept AS b, count(*) AS chunks FROM presence x JOIN presence y ON x.passage = y.passage AND x.concept < y.concept GROUP BY 1, 2 HAVING count(*) >= 2)"""


@query(f"WITH {EDGES_SQL} SELECT * FROM edges")
def passage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concepts.cooccurrence_edges(presence(spark, sf_dir), 2)


STRENGTH_SQL = """{0}_s AS (
  SELECT a, b, round((SELECT count(*) FROM pd x, pd y, {0}_l l WHERE x.concept = edges.a AND y.concept = edges.b AND l.a = x.doc AND l.b = y.doc)
    / (SELECT count(*) FROM pd x, pd y WHERE x.concept = edges.a AND y.concept = edges.b AND x.doc <> y.doc), 6) AS strength FROM edges)"""
LINKS_SQL = """pd AS (SELECT DISTINCT concept, doc FROM presence), citation_l AS (SELECT doc_id AS a, doc_id + 1 AS b FROM documents WHERE doc_id % 20 = 0 UNION SELECT doc_id + 1, doc_id FROM documents WHERE doc_id % 20 = 0
), similarity_l AS (SELECT doc_id AS a, doc_id + 7 AS b FROM documents WHERE doc_id % 50 = 1 UNION SELECT doc_id + 7, doc_id FROM documents WHERE doc_id % 50 = 1)"""


def links(spark: SparkSession, sf_dir: str, step: int, rest: int, width: int) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(F.col("doc_id") % width == rest).select(F.col("doc_id").alias("a"), (F.col("doc_id") + step).alias("b"))


WEIGHTED_SQL = f"""WITH {EDGES_SQL}, {LINKS_SQL}, {STRENGTH_SQL.format("citation")}, {STRENGTH_SQL.format("similarity")}, m AS (
  SELECT e.a, e.b, chunks, nullif(c.strength, 0) AS sc, nullif(s.strength, 0) AS ss FROM edges e JOIN citation_s c ON e.a = c.a AND e.b = c.b JOIN similarity_s s ON e.a = s.a AND e.b = s.b
), w AS (SELECT a, b, chunks, list_filter(['citation:' || sc, 'cooccurrence', 'similarity:' || ss], lambda x: x IS NOT NULL) AS p, (sc IS NOT NULL)::INT + (ss IS NOT NULL)::INT AS k, coalesce(sc, 0) + coalesce(ss, 0) AS t FROM m)"""


def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = presence(spark, sf_dir)
    edges = materialize(concepts.cooccurrence_edges(found, 2), "edges")
    strengths = {n: concepts.provenance_strength(edges, found, links(spark, sf_dir, *x)) for n, x in {"citation": (1, 0, 20), "similarity": (7, 1, 50)}.items()}
    return concepts.weighted_edges(edges, strengths)


@query(f"""{WEIGHTED_SQL} SELECT a, b, chunks, array_to_string(list_transform(p, lambda x: string_split(x, ':')[1]), ',') AS provenance,
  round(1 + k + 0.5 * CASE WHEN k > 0 THEN t / k ELSE 0 END + 0.5 * (1 - 1 / (1 + chunks)), 6) AS weight FROM w""")
def weighted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted(spark, sf_dir)


@query(f"""{WEIGHTED_SQL}, r AS (SELECT a, b, round(1 + k + 0.5 * CASE WHEN k > 0 THEN t / k ELSE 0 END + 0.5 * (1 - 1 / (1 + chunks)), 6) AS weight, CASE WHEN a = 1 THEN 'uses' END AS relation FROM w)
SELECT a, b, relation, round(weight + CASE WHEN relation IS NULL THEN 0 ELSE 1 END, 6) AS weight FROM r""")
def reattached_stances(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = weighted(spark, sf_dir)
    kept = spark.createDataFrame([(1, b, "uses") for b in range(2, 10)], "a long, b long, relation string")
    return concepts.reattach_stances(edges, kept).select("a", "b", "relation", "weight")


STANCES_SQL = """stances AS (SELECT doc_id % 9 + 1 AS a, doc_id % 7 + 11 AS b, doc_id AS doc, CASE WHEN doc_id % 9 < 3 THEN 'supports' WHEN doc_id % 4 = 0 THEN 'contradicts' WHEN doc_id % 4 = 1 THEN 'neutral' ELSE 'extends' END AS polarity FROM documents WHERE doc_id % 3 = 0 OR doc_id % 9 > 6
), years AS (SELECT doc_id AS doc, CASE WHEN doc_id % 4 = 0 THEN 2000 + doc_id % 30 ELSE 1990 + doc_id % 30 END AS year FROM documents WHERE doc_id % 63 <> 8)"""


def stances(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k, docs = F.col("doc_id"), table(spark, sf_dir, "documents")
    polarity = F.when(k % 9 < 3, "supports").when(k % 4 == 0, "contradicts").when(k % 4 == 1, "neutral").otherwise("extends")
    rows = docs.filter((k % 3 == 0) | (k % 9 > 6)).select((k % 9 + 1).alias("a"), (k % 7 + 11).alias("b"), k.alias("doc"), polarity.alias("polarity"))
    years = docs.filter(k % 63 != 8).select(k.alias("doc"), F.when(k % 4 == 0, 2000 + k % 30).otherwise(1990 + k % 30).alias("year"))
    return rows, years


SIDES = "count(DISTINCT doc) FILTER (polarity IN ('supports', 'extends', 'agrees')) AS n_supporting, count(DISTINCT doc) FILTER (polarity IN ('contradicts', 'refutes', 'disagrees')) AS n_opposing"


@query(f"WITH {STANCES_SQL} SELECT a, b, {SIDES} FROM stances GROUP BY a, b HAVING n_supporting > 0 AND n_opposing > 0")
def contested_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concepts.contested_edges(stances(spark, sf_dir)[0])


@query(f"WITH {STANCES_SQL} SELECT a, b, count(DISTINCT polarity) AS n_polarities, count(*) AS n_stances, max(polarity) AS last_polarity FROM stances GROUP BY a, b")
def stance_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concepts.stance_profile(stances(spark, sf_dir)[0])


WEIGHTS_SQL = f"""{STANCES_SQL}, nodes AS (SELECT unnest(range(0, 19)) AS concept), ends AS (SELECT DISTINCT unnest([a, b]) AS concept, doc, polarity = 'contradicts' AS opp FROM stances WHERE polarity <> 'neutral'
), g AS (SELECT concept, count(*) FILTER (NOT opp) AS s, count(*) FILTER (opp) AS o, count(*) = count(year) AS dated, median(year) FILTER (NOT opp) AS ms, median(year) FILTER (opp) AS mo FROM ends LEFT JOIN years USING (doc) GROUP BY concept
), weights AS (SELECT concept, coalesce(s, 0) AS n_supporting, coalesce(o, 0) AS n_opposing, CASE WHEN s IS NULL THEN 1.0 ELSE round(s / (s + o), 4) END AS agreement,
  CASE WHEN o > 0 THEN 'contested' WHEN s > 1 THEN 'corroborated' ELSE 'unique' END AS coverage,
  CASE WHEN coalesce(o, 0) = 0 THEN 'stable' WHEN s >= 2 AND o >= 2 AND dated AND mo > ms THEN 'superseded_trend' ELSE 'contested' END AS direction FROM nodes LEFT JOIN g USING (concept))"""


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concepts.node_weights(spark.range(19).toDF("concept"), *stances(spark, sf_dir))


@query(f"WITH {WEIGHTS_SQL} SELECT * FROM weights")
def node_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights(spark, sf_dir)


PROJECTED_SQL = f"""{WEIGHTS_SQL}, {PRESENCE_SQL}, projected AS (SELECT passage, doc, count(*) AS n_claims, count(*) FILTER (coverage = 'corroborated') AS n_corroborated, count(*) FILTER (coverage = 'unique') AS n_unique,
  count(*) FILTER (coverage = 'contested') AS n_contested, count(*) FILTER (direction = 'superseded_trend') AS n_superseded FROM presence JOIN weights USING (concept) GROUP BY passage, doc)"""
MARKERS_SQL = "concat_ws(',', CASE WHEN n_contested > 0 THEN 'contested' END, CASE WHEN n_superseded > 0 THEN 'superseded_trend' END) AS markers"


@query(f"WITH {PROJECTED_SQL} SELECT *, {MARKERS_SQL}, CASE WHEN n_contested > 0 THEN 'contested' WHEN n_corroborated > 0 THEN 'corroborated' ELSE 'unique' END AS label FROM projected")
def passage_epistemics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = concepts.project_weights(presence(spark, sf_dir), weights(spark, sf_dir))
    return out.withColumn("label", concepts.coverage_label(F.col("n_contested"), F.col("n_corroborated"), F.col("n_claims")))


@query(f"WITH {PROJECTED_SQL}, m AS (SELECT passage, {MARKERS_SQL} FROM projected) SELECT * FROM m WHERE markers <> '' AND ends_with(passage, ':p0')")
def marked_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "documents").select(F.concat("doc_id", F.lit(":p0")).alias("passage"))
    return concepts.marked(asked, concepts.project_weights(presence(spark, sf_dir), weights(spark, sf_dir)))


@query(f"WITH {PRESENCE_SQL} SELECT concept, min(doc) AS doc FROM presence GROUP BY concept HAVING count(DISTINCT doc) = 1")
def single_source_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concepts.single_source(presence(spark, sf_dir))


@query(f"""WITH {PRESENCE_SQL.replace("SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL", "SELECT conv_id * 100 + turn AS doc_id, [text] AS l FROM conversations WHERE turn % 2 = 0")}
SELECT concept, array_to_string(list_sort(list(DISTINCT doc)), ',') AS claims FROM presence GROUP BY concept""")
def unsourced_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn")
    claims = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + turn).alias("claim"), "text", F.when(turn % 2 == 0, "unsupported").otherwise("ok").alias("marker"))
    return concepts.unsourced_claims(claims, vocabulary(spark))


GAPS_SQL = """gaps AS (SELECT l_orderkey AS concept, CASE l_linenumber % 5 WHEN 0 THEN 'isolated' WHEN 1 THEN 'under_connected' WHEN 2 THEN 'single_source' WHEN 3 THEN 'thin_bridge' ELSE 'unsourced_claim' END AS kind, min(CASE WHEN l_suppkey % 3 = 0 THEN 'dismissed' ELSE 'surfaced' END) AS status FROM lineitem GROUP BY 1, 2
), triage AS (SELECT concept, kind, 'promoted' AS status FROM gaps WHERE concept % 10 = 0), listed AS (
  SELECT concept, kind, coalesce(o_orderpriority, CAST(concept AS VARCHAR)) AS label, coalesce(t.status, g.status) AS status, list_position(['unsourced_claim', 'thin_bridge', 'single_source', 'isolated', 'under_connected'], kind) - 1 AS rank
  FROM gaps g LEFT JOIN triage t USING (concept, kind) LEFT JOIN orders ON o_orderkey = concept AND concept % 2 = 0)"""


def gap_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Order lines stand for gaps, orders for concepts."""
    kind = F.element_at(F.array(*(F.lit(k) for k in ("isolated", "under_connected", "single_source", "thin_bridge", "unsourced_claim"))), (F.col("l_linenumber") % 5 + 1).cast("int"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("concept"), kind.alias("kind"), F.when(F.col("l_suppkey") % 3 == 0, "dismissed").otherwise("surfaced").alias("status"))
    gaps = lines.groupBy("concept", "kind").agg(F.min("status").alias("status"))
    triage = gaps.filter("concept % 10 = 0").select("concept", "kind", F.lit("promoted").alias("status"))
    labels = table(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("concept"), F.col("o_orderpriority").alias("label"))
    return gaps, triage, labels


@query(f"WITH {GAPS_SQL} SELECT * FROM listed")
def gap_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concepts.gap_list(*gap_tables(spark, sf_dir))


@query(f"""WITH {GAPS_SQL}, v AS (SELECT * FROM listed WHERE status <> 'dismissed' AND kind <> 'under_connected')
SELECT c.concept, any_value(c.label) AS label, min(v.rank) AS best_rank, count(v.rank) AS n_gaps FROM listed c LEFT JOIN v ON v.concept = c.concept AND v.kind = c.kind GROUP BY c.concept""")
def concept_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = concepts.gap_list(*gap_tables(spark, sf_dir))
    return concepts.index_rows(listed.select("concept", "label").distinct(), concepts.visible_gaps(listed))


STORED = [(1, "isolated", "deterministic", "surfaced"), (2, "thin", "stochastic", "promoted"), (3, "thin", "stochastic", "surfaced"), (4, "thin", "stochastic", "dismissed"), (9, "thin", "stochastic", "surfaced")]
GAP = "concept long, kind string, determinism string, status string"


@query("""SELECT * FROM (VALUES (2, 'thin', 'stochastic', 'promoted'), (3, 'other', 'stochastic', 'surfaced'), (4, 'thin', 'stochastic', 'dismissed'), (5, 'other', 'stochastic', 'surfaced'), (7, 'isolated', 'deterministic', 'surfaced')) AS t(concept, kind, determinism, status)""")
def gap_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic rows replaced; stochastic ones merged, kept where triaged, gone with their concept (9)."""
    stored = concepts.replace_gaps(spark.createDataFrame(STORED, GAP), spark.createDataFrame([(7, "isolated", "deterministic", "surfaced")], GAP))
    suggested = spark.createDataFrame([(k, "other") for k in (2, 3, 4, 5)], "concept long, kind string")
    return concepts.suggest_gaps(stored, suggested, spark.range(9).toDF("concept"))


@query("SELECT * FROM (VALUES (1, 'a', 'dismissed'), (3, 'a', 'promoted')) AS t(concept, kind, status)")
def gap_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "concept long, kind string, status string"
    return concepts.set_triage(spark.createDataFrame([(1, "a", "dismissed"), (2, "a", "promoted"), (3, "a", "dismissed")], schema), spark.createDataFrame([(2, "a", "surfaced"), (3, "a", "promoted")], schema))


MERGE_PAIRS = [(1, 9), (9, 4), (3, 7)]
MERGE_SQL = f"{ROWS_SQL}, plan AS (SELECT * FROM (VALUES (1, 1), (9, 1), (4, 1), (3, 3), (7, 3)) AS t(concept, keeper))"


def merge_plan_of(spark: SparkSession) -> DataFrame:
    return concepts.merge_plan(spark.createDataFrame(MERGE_PAIRS, "a long, b long"), vocabulary(spark))


@query(f"WITH {MERGE_SQL} SELECT * FROM plan")
def concept_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_plan_of(spark)


@query("SELECT * FROM (VALUES (1, 'The,das,der,in,is,le,of'), (2, 'et,und'), (3, 'la,los,was'), (5, 'que'), (6, 'en'), (8, '')) AS t(concept, aliases)")
def merged_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = vocabulary(spark).withColumn("label", F.lower(F.trim("label"))).withColumn("label", F.when(F.col("concept") == 1, "the").otherwise(F.col("label")))
    own = own.withColumn("aliases", F.filter("aliases", lambda x: x != "The"))
    own = own.withColumn("aliases", F.when(F.col("concept") == 9, F.concat("aliases", F.array(F.lit("THE x")))).otherwise(F.col("aliases")))
    out = concepts.apply_merges(own, merge_plan_of(spark))
    fixed = F.transform("aliases", lambda x: F.when(x == "THE x", "The").otherwise(x))
    return out.select("concept", F.array_join(F.array_sort(fixed), ",").alias("aliases"))


FAMILY_NAMES = ["network", "networks", "Databases", "database", "class", "classes", "study", "studies", "glass", "gas", "alone"]


@query("SELECT * FROM (VALUES ('class', 'classes'), ('database', 'Databases'), ('network', 'networks'), ('study', 'studies')) AS t(canonical, members)")
def morphological_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concepts.morphological_families(spark.createDataFrame([(n,) for n in FAMILY_NAMES], "name string"))


CLUSTERS_SQL = """m AS (SELECT doc_id AS doc, doc_id % 12 AS cluster FROM documents), e AS (SELECT doc_id AS a, doc_id + 1 AS b FROM documents WHERE doc_id % 20 = 0 UNION SELECT doc_id + 1, doc_id FROM documents WHERE doc_id % 20 = 0)"""


@query(f"WITH {CLUSTERS_SQL} SELECT DISTINCT x.cluster AS x, y.cluster AS y FROM e JOIN m x ON x.doc = a JOIN m y ON y.doc = b WHERE x.cluster <> y.cluster")
def cluster_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), (F.col("doc_id") % 12).alias("cluster"))
    return concepts.cluster_links(members, links(spark, sf_dir, 1, 0, 20))


@query(f"""WITH {PRESENCE_SQL}, v AS (SELECT doc, concept % 3 AS community, count(DISTINCT concept) AS k FROM presence GROUP BY 1, 2
), b AS (SELECT doc, community FROM v QUALIFY row_number() OVER (PARTITION BY doc ORDER BY k DESC, community) = 1) SELECT doc_id AS doc, coalesce(CAST(community AS VARCHAR), 'solo:' || doc_id) AS cluster FROM documents LEFT JOIN b ON doc = doc_id""")
def document_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    communities = vocabulary(spark).select("concept", (F.col("concept") % 3).alias("community"))
    return concepts.document_clusters(presence(spark, sf_dir), communities, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc")))


@query(f"WITH {EDGES_SQL}, e AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges) SELECT a AS concept, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM e JOIN vocabulary ON concept = b GROUP BY a")
def neighbour_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concepts.neighbour_labels(concepts.cooccurrence_edges(presence(spark, sf_dir), 2), vocabulary(spark))


@query(f"""WITH {PRESENCE_SQL}, t AS (SELECT concept, doc, sum(n) AS n FROM presence GROUP BY 1, 2), r AS (SELECT concept, doc, CAST(row_number() OVER (PARTITION BY concept ORDER BY n DESC, doc) AS INT) AS place FROM t JOIN documents ON doc_id = doc)
SELECT concept, place, d.source || ' ' || doc AS title FROM r JOIN documents d ON doc_id = doc WHERE place <= 3""")
def concept_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.concat("source", F.lit(" "), "doc_id").alias("title"))
    return concepts.concept_context(presence(spark, sf_dir), titles)


@query(f"WITH {PRESENCE_SQL}, b AS (SELECT DISTINCT concept FROM presence UNION SELECT 77) SELECT concept, 'added' AS state FROM vocabulary WHERE concept NOT IN (SELECT concept FROM b) UNION ALL SELECT concept, 'removed' FROM b WHERE concept NOT IN (SELECT concept FROM vocabulary)")
def graph_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = presence(spark, sf_dir).select("concept").unionByName(spark.createDataFrame([(77,)], "concept long"))
    return concepts.staleness(vocabulary(spark), built)


@query(f"""WITH {EDGES_SQL}, h AS (SELECT sha256(a || '|' || b || '|' || chunks) AS h FROM edges), s AS (SELECT count(*) AS n, CAST(sum(('0x' || substr(h, 1, 8))::BIGINT) AS BIGINT) AS s0, CAST(sum(('0x' || substr(h, 9, 8))::BIGINT) AS BIGINT) AS s1, CAST(sum(('0x' || substr(h, 17, 8))::BIGINT) AS BIGINT) AS s2, CAST(sum(('0x' || substr(h, 25, 8))::BIGINT) AS BIGINT) AS s3 FROM h)
SELECT substr(sha256(concat_ws('|', n, s0, s1, s2, s3, 'seed=42')), 1, 16) AS version FROM s""")
def graph_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concepts.graph_version(concepts.cooccurrence_edges(presence(spark, sf_dir), 2), "seed=42")


@query("""WITH v AS (SELECT vec_id AS id, 'name-' || vec_id % 40 AS name, embedding::DOUBLE[] AS e FROM embeddings)
SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.e, b.e), 5) AS score FROM v a JOIN v b ON a.id < b.id AND round(list_cosine_similarity(a.e, b.e), 5) >= 0.3""")
def nearest_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of vectors at a cosine of 0.3 or more."""
    return vector_index.near_pairs(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), 0.3)
