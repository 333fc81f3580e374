"""Queries: communities of the co-occurrence graph, and thin bridges of a graph of suppliers and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import bridges, communities
from lectern.operators.scratch import materialize
from lectern.plans.corpus import VOCABULARY_SQL, pairs_of, presence_table
from lectern.plans.registry import query, table


def concept_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The vocabulary, and its pairs in documents with their weights."""
    presence = presence_table(spark, sf_dir)
    return presence.select(F.col("term").alias("node")).distinct(), materialize(pairs_of(presence), "pairs")


@query()
def concept_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return communities.skeleton(*concept_graph(spark, sf_dir))[0]


@query()
def community_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return communities.skeleton(*concept_graph(spark, sf_dir))[1]


PAIRS_SQL = f"""{VOCABULARY_SQL}, pairs AS (SELECT x.term AS a, y.term AS b, round(1 + 0.5 * (1 - 1 / (1 + count(*))), 6) AS weight FROM presence x JOIN presence y ON x.doc = y.doc AND x.term < y.term GROUP BY x.term, y.term HAVING count(*) >= 2
), ends AS (SELECT a AS node, weight FROM pairs UNION ALL SELECT b, weight FROM pairs)"""


@query(f"""WITH {PAIRS_SQL}, d AS (SELECT term AS node, count(weight) AS degree, coalesce(sum(weight), 0) AS k FROM (SELECT DISTINCT term FROM presence) LEFT JOIN ends ON node = term GROUP BY term)
SELECT count(*) AS n_nodes, CAST(sum(degree) AS BIGINT) AS ends, round(sum(k), 3) AS strength, CAST(count(*) AS BIGINT) AS placed, TRUE AS numbered, TRUE AS better_than_one FROM d""")
def community_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node has one community, the numbers have no gap, and modularity, taken anew from the labels, is not below that of one community."""
    nodes, edges = concept_graph(spark, sf_dir)
    members, groups = communities.skeleton(nodes, edges)
    members = materialize(members, "members")
    better = communities.modularity(members.select("node", "community"), edges) >= 0
    weight = edges.agg(F.round(2 * F.sum("weight"), 3).alias("strength"))
    numbers = groups.agg((F.max("community") + 1 == F.count("*")).alias("numbered"), F.sum("size").alias("placed"))
    counted = members.agg(F.count_distinct("node").alias("n_nodes"), F.sum("degree").alias("ends"))
    return counted.join(weight).join(numbers).select("n_nodes", "ends", F.coalesce("strength", F.lit(0.0)).alias("strength"), "placed", "numbered", F.lit(better).alias("better_than_one"))


# Suppliers and the parts of which a line has fifty pieces; parts are numbered on from ten billion.
SUPPLY_SQL = """pairs AS (SELECT DISTINCT l_suppkey AS a, l_partkey + 10000000000 AS b FROM lineitem WHERE l_quantity = 50
), e AS (SELECT a, b, a AS u, b AS v FROM pairs UNION ALL SELECT b, a, a, b FROM pairs
), away AS (SELECT u, v, u AS node FROM e UNION SELECT away.u, away.v, e.b FROM away JOIN e ON e.a = node AND (e.u, e.v) <> (away.u, away.v)
), cut AS (SELECT a, b FROM pairs WHERE NOT EXISTS (SELECT 1 FROM away WHERE u = pairs.a AND v = pairs.b AND node = pairs.b))"""


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").filter("l_quantity = 50").select(F.col("l_suppkey").cast("long").alias("a"), (F.col("l_partkey") + 10_000_000_000).alias("b"))


@query(f"WITH RECURSIVE {SUPPLY_SQL} SELECT a, b FROM cut")
def graph_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridges.bridges(supply(spark, sf_dir))


@query(f"WITH RECURSIVE {SUPPLY_SQL}, f AS (SELECT node, min((a, b)) AS p FROM (SELECT a AS node, a, b FROM cut UNION ALL SELECT b, a, b FROM cut) GROUP BY node) SELECT node, p[1] AS a, p[2] AS b FROM f")
def thin_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridges.thin_bridges(supply(spark, sf_dir))
