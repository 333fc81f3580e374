"""Neighbours of every vector over a threshold, by an inverted file of centroids with exact verification.

Centroids are fitted to a bounded sample; every vector is listed under its nearest centroid. Angles on
the unit sphere obey the triangle inequality, so a vector whose angle to a query is at most A can only
stand in a list whose centroid is within A plus the list's radius of the query. That gives the exact
search; with ``probes`` a query reads only so many of its nearest lists, and may miss some. What is
read is verified: blocks of a list and of its queries are multiplied in one task, of bounded size.

Vectors that are null, zero, or hold null or what is not finite have no neighbours. Identifiers that
repeat are rows by themselves, but never neighbours of each other; rows without identifier go.
Vectors of several lengths are a mistake and end the job.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.vectors import cosine
from lectern.operators.scratch import materialize

#: Vectors a list should have, lists there are at most, sampled vectors a list, and rounds of the fit.
LIST_ROWS, MOST_LISTS, SAMPLE_ROWS, FIT_ROUNDS = 4096, 1024, 64, 8
#: Members and queries of one block.
MEMBER_BLOCK, QUERY_BLOCK = 8192, 16384
DIGITS = 5
#: Angles are compared with this much room for their rounding.
ROOM = 1e-6


def unit(vectors: DataFrame) -> DataFrame:
    """id, v of the vectors that have a direction, as unit vectors in double precision."""
    rows = vectors.filter("id IS NOT NULL").select("id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = rows.filter(finite & (length > 0)).withColumn("_length", length)
    return rows.select("id", F.transform("v", lambda x: x / F.col("_length")).alias("v"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit(rows: DataFrame, n_lists: int) -> np.ndarray:
    """Unit centroids: means of directions over the ``n_lists * SAMPLE_ROWS`` vectors whose identifiers have the smallest hashes."""
    sample = matrix(rows.orderBy(F.xxhash64("id"), "v").limit(n_lists * SAMPLE_ROWS).select("v").toArrow().column("v"))
    if not len(sample):
        return np.zeros((0, 0))
    centroids = sample[:n_lists].copy()
    for _ in range(FIT_ROUNDS):
        nearest = (sample @ centroids.T).argmax(axis=1)
        for k in np.unique(nearest):
            mean = sample[nearest == k].sum(axis=0)
            if (size := np.sqrt(mean @ mean)) > 0:
                centroids[k] = mean / size
    return centroids


def angles(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(v @ centroids.T, -1.0, 1.0))


def listed(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """id, v, list, angle: each vector under its nearest centroid."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                far = angles(matrix(batch.column(1)), centroids)
                near = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32()), pa.array(far[np.arange(len(near)), near])], names=["id", "v", "list", "angle"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, v array<double>, list int, angle double")


def probing(queries: DataFrame, centroids: np.ndarray, radii: np.ndarray, threshold: float, probes: int | None) -> DataFrame:
    """id, v, list: the lists that each query reads; ``radii`` is -1 for empty lists."""
    reach = math.acos(max(-1.0, min(1.0, threshold - 10.0**-DIGITS)))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            far = angles(matrix(batch.column(1)), centroids)
            read = (far <= reach + radii + ROOM) & (radii >= 0)
            if probes is not None:
                full = np.where(radii >= 0, far, np.inf)
                last = np.sort(full, axis=1)[:, min(probes, full.shape[1]) - 1]
                read &= full <= last[:, None]
            row, at = np.nonzero(read)
            for a in range(0, len(row), 4096):
                taken = batch.take(pa.array(row[a : a + 4096]))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(at[a : a + 4096], pa.int32())], names=["id", "v", "list"])

    return queries.mapInArrow(run, f"id {queries.schema['id'].dataType.simpleString()}, v array<double>, list int")


def neighbours(vectors: DataFrame, queries: DataFrame, threshold: float, k: int | None = None, probes: int | None = None) -> DataFrame:
    """query, doc, score, rank: for each of ``queries`` the ``k`` nearest of ``vectors`` (id, embedding), or all, with a rounded cosine of ``threshold`` or more.

    Ranks are by score, then identifier. Exact without ``probes``.
    """
    rows = materialize(unit(vectors), "vectors")
    n = rows.count()
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"query {kind}, doc {kind}, score double"
    if not n:
        return vectors.sparkSession.createDataFrame([], schema + ", rank int")
    centroids = fit(rows, max(1, min(MOST_LISTS, -(-n // LIST_ROWS))))
    members = materialize(listed(rows, centroids), "lists")
    sizes = members.groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()  # at most MOST_LISTS rows
    radii = np.full(len(centroids), -1.0)
    radii[[r.list for r in sizes]] = [r.radius for r in sizes]
    asked = probing(unit(queries), centroids, radii, threshold, probes)  # taken twice rather than written, as each query stands under every list that it reads
    parts = asked.groupBy("list").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("q_parts"))
    spark = vectors.sparkSession
    own = spark.createDataFrame([(r.list, -(-r.n // MEMBER_BLOCK)) for r in sizes], "list int, m_parts long")
    plan = materialize(parts.join(own, "list"), "plan")  # one row a list

    def dealt(count: str, salt: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(salt), "id", "v"), F.col(count))

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))

    planned = F.broadcast(plan)
    left = members.join(planned, "list").select("list", dealt("m_parts", "m").alias("m"), every("q_parts").alias("q"), "id", "v")
    right = asked.join(planned, "list").select("list", every("m_parts").alias("m"), dealt("q_parts", "q").alias("q"), "id", "v")
    type_ = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind]
    arrow = pa.schema([("query", type_), ("doc", type_), ("score", pa.float64())])

    def met(own: pa.Table, asked: pa.Table) -> pa.Table:
        if not own.num_rows or not asked.num_rows:
            return arrow.empty_table()
        ids, wanted = own.column("id").combine_chunks(), asked.column("id").combine_chunks()
        m, q = matrix(own.column("v")), matrix(asked.column("v"))
        names = ids.to_numpy(zero_copy_only=False)
        same = int(np.unique(names, return_counts=True)[1].max())  # rows that may be the query's own
        out = []
        for a in range(0, len(q), 256):  # 256 queries' scores at a time
            scores = np.round(q[a : a + 256] @ m.T, DIGITS)
            row, at = np.nonzero(scores >= threshold)
            if k is not None:  # no more than k of a block can be among a query's k; one more stands in for itself
                best = np.lexsort((names[at], -scores[row, at], row))
                row, at = row[best], at[best]
                kept = np.arange(len(row)) - np.searchsorted(row, row) < k + same
                row, at = row[kept], at[kept]
            table = pa.table([wanted.take(pa.array(row + a)), ids.take(pa.array(at)), pa.array(scores[row, at])], schema=arrow)
            out.append(table.filter(pa.compute.not_equal(table.column("query"), table.column("doc"))))
        return pa.concat_tables(out)

    scored = left.groupBy("list", "m", "q").cogroup(right.groupBy("list", "m", "q")).applyInArrow(met, schema)
    if k is None:
        return scored.withColumn("rank", F.lit(None).cast("int"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def similarity_edges(vectors: DataFrame, threshold: float, k: int = 10, probes: int | None = None) -> DataFrame:
    """query, doc, score, rank: the directed edges of every vector."""
    return neighbours(vectors, vectors, threshold, k, probes)


def near_pairs(vectors: DataFrame, threshold: float) -> DataFrame:
    """a, b, score: all pairs with a rounded cosine of ``threshold`` or more, a < b."""
    return neighbours(vectors, vectors, threshold).filter("query < doc").select(F.col("query").alias("a"), F.col("doc").alias("b"), "score")


def pooled(rows: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """``key``, v: the mean of each key's vectors, of ``dim`` components each; sums are taken before the shuffle."""
    means = rows.groupBy(key).agg(*(F.avg(F.col(vector)[k].cast("double")).alias(f"_{k}") for k in range(dim)))
    return means.select(key, F.array(*(F.col(f"_{k}") for k in range(dim))).alias("v"))


def frequent(counts: DataFrame, pool: int = 80) -> DataFrame:
    """``counts`` (doc, term, tf) with place, of each document's ``pool`` most frequent terms; equal counts are taken in order of the term."""
    order = Window.partitionBy("doc").orderBy(F.desc("tf"), "term")
    return counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= pool)


def anchor_ranked(counts: DataFrame, terms: DataFrame, anchors: DataFrame, k: int, pool: int = 80) -> DataFrame:
    """doc, term, score, rank: the ``k`` best of each document's ``pool`` most frequent terms by the cosine to its anchor.

    ``counts`` has doc, term, tf; ``terms`` term, v; ``anchors`` doc, anchor. Without an anchor the terms keep the order of their counts, and their score is 0; a term without vector has 0.
    """
    met = frequent(counts, pool).join(terms, "term", "left").join(anchors, "doc", "left")
    score = F.when(F.col("anchor").isNotNull() & F.col("v").isNotNull(), F.round(cosine(F.col("v"), F.col("anchor")), DIGITS)).otherwise(0.0)
    met = met.select("doc", "term", score.alias("score"), F.when(F.col("anchor").isNull(), F.col("place")).otherwise(0).alias("place"))
    best = Window.partitionBy("doc").orderBy("place", F.desc("score"), "term")
    return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("doc", "term", "score", "rank")
