"""Queries: neighbours of every vector over a threshold, and terms ranked by their documents' vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import pools, vector_index
from lectern.plans.registry import query, table, texts
from lectern.plans.search import STOPWORDS, TERMS_SQL

COSINE = "round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 5)"
SIMS_SQL = f"v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), sims AS (SELECT a.id AS query, b.id AS doc, {COSINE} AS score FROM v a JOIN v b ON a.id <> b.id)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


@query(f"WITH {SIMS_SQL} SELECT query, doc, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INT) AS rank FROM sims WHERE score >= 0.25 QUALIFY rank <= 10")
def similarity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's ten nearest at a cosine of 0.25 or more, exactly."""
    return vector_index.similarity_edges(vectors(spark, sf_dir), 0.25)


@query()
def similarity_edges_probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the 64 nearest lists of each vector, which may miss some; the tests measure how many."""
    return vector_index.similarity_edges(vectors(spark, sf_dir), 0.25, probes=64)


# Documents have the vector of their number, as far as there are so many.
ANCHOR_SQL = f"""{TERMS_SQL}, words AS (SELECT doc, term, tf FROM counts WHERE NOT contains(term, ' ')
), held AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY tf DESC, term) AS place FROM words QUALIFY place <= 80
), parts AS (SELECT term, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM held JOIN embeddings ON vec_id = doc, unnest(range(1, 65)) AS u(i) GROUP BY term, i
), met AS (SELECT h.doc, h.term, sum(p.x * CAST(embedding[i] AS DOUBLE)) / (sqrt(sum(p.x * p.x)) * sqrt(sum(CAST(embedding[i] AS DOUBLE) * CAST(embedding[i] AS DOUBLE)))) AS score
  FROM held h JOIN embeddings ON vec_id = h.doc JOIN parts p ON p.term = h.term GROUP BY h.doc, h.term
), scored AS (SELECT doc, term, coalesce(round(score, 5), 0) AS score, CASE WHEN doc IN (SELECT vec_id FROM embeddings) THEN 0 ELSE place END AS place FROM held LEFT JOIN met USING (doc, term))"""


@query(f"WITH {ANCHOR_SQL} SELECT doc, term, score, CAST(row_number() OVER (PARTITION BY doc ORDER BY place, score DESC, term) AS INT) AS rank FROM scored QUALIFY rank <= 15")
def anchor_ranked_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A term's vector is the mean of those of the documents in whose pools it stands; a document's anchor is its own."""
    anchors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("anchor"))
    return pools.pool_ranked(pools.pools(texts(spark, sf_dir), STOPWORDS), anchors, 15)
