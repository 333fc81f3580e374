"""Hybrid retrieval: dense ranking, rank fusion, de-duplication, collapse to parents, comparison of runs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

# The constant of reciprocal rank fusion and the caps of a retrieval.
RRF_C, CANDIDATE_CAP = 60, 60
#: Queries and vectors of a block at most, vectors that a block should have at least, and scores that are held at once.
QUERY_BLOCK, MEMBER_BLOCK, LEAST_BLOCK, SCORES = 4096, 32768, 1024, 1 << 22
DIGITS = 5
#: Items that are sent to every task at most.
BROADCAST_ITEMS = 200_000


def directed(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors divided by their lengths, in double precision, and their numbers of components, -1 for what is null or holds a null."""
    lists = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    if len(sizes) and not lists.null_count and (sizes == sizes[0]).all() and not lists.flatten().null_count:
        m = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(sizes), -1)
    else:
        m = np.zeros((len(sizes), max(0, *sizes, 0)))
        for k, v in enumerate(lists.to_pylist()):
            if v and None not in v:
                m[k, : len(v)] = v
            elif v:
                sizes[k] = -1
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    with np.errstate(invalid="ignore"):
        return np.divide(m, length, out=np.zeros_like(m), where=~(length == 0)), sizes


def nearest(ids: np.ndarray, m: np.ndarray, sizes: np.ndarray, wanted: np.ndarray, q: np.ndarray, q_sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``q`` and of ``m`` and their score, of the ``k`` best of each query by score, then identifier; not a number comes first, as in Spark."""
    width = max(m.shape[1], q.shape[1])
    m, q = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (m, q))
    same_size = sizes[0] >= 0 and (sizes == sizes[0]).all() and (q_sizes == sizes[0]).all()
    with np.errstate(invalid="ignore"):
        scores = np.round(q @ m.T, DIGITS) + 0.0
    if not same_size:
        scores[(q_sizes[:, None] != sizes[None, :]) | (sizes < 0)[None, :]] = 0.0
    order = np.where(np.isnan(scores), np.inf, scores)
    order[wanted[:, None] == ids[None, :]] = -np.inf
    least = np.partition(order, len(ids) - k, axis=1)[:, len(ids) - k] if k < len(ids) else np.full(len(q), -np.inf)
    row, at = np.nonzero((order >= least[:, None]) & (order > -np.inf))
    by = np.lexsort((ids[at], -order[row, at], row))
    row, at = row[by], at[by]
    first = np.searchsorted(row, row)
    kept = np.arange(len(row)) - first < k
    return row[kept], at[kept], scores[row[kept], at[kept]]


def dense_rank(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query, doc, score, rank: exact cosine of each query with every vector; both have id, embedding.

    Blocks of vectors meet blocks of queries, each pair of blocks in one task, as products of matrices;
    of each pair only the ``k`` best of a query leave the task.
    """
    spark = vectors.sparkSession
    vectors = vectors.filter("id IS NOT NULL").select("id", "embedding")
    queries = queries.filter("id IS NOT NULL").select(F.col("id").alias("query"), F.col("embedding").alias("vector"))
    n, asked = vectors.count(), queries.count()
    m_parts = max(1, -(-n // MEMBER_BLOCK), min(spark.sparkContext.defaultParallelism, n // LEAST_BLOCK))
    q_parts = max(1, -(-asked // QUERY_BLOCK))

    def block(key: str, parts: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")

    def every(parts: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    left = vectors.select(block("id", m_parts).alias("m"), every(q_parts).alias("q"), "id", "embedding")
    right = queries.select(every(m_parts).alias("m"), block("query", q_parts).alias("q"), "query", "vector")
    kinds = [to_arrow_type(x.schema[0].dataType) for x in (queries, vectors)]
    arrow = pa.schema([("query", kinds[0]), ("doc", kinds[1]), ("score", pa.float64())])

    def met(own: pa.Table, asked: pa.Table) -> pa.Table:
        if not own.num_rows or not asked.num_rows:
            return arrow.empty_table()
        ids, wanted = own.column("id").combine_chunks(), asked.column("query").combine_chunks()
        i, w = (x.to_numpy(zero_copy_only=False) for x in (ids, wanted))
        (m, sizes), (q, q_sizes) = directed(own.column("embedding")), directed(asked.column("vector"))
        step = max(1, SCORES // len(i))
        out = []
        for a in range(0, len(w), step):  # SCORES scores at a time
            row, at, score = nearest(i, m, sizes, w[a : a + step], q[a : a + step], q_sizes[a : a + step], k)
            out.append(pa.table([wanted.take(pa.array(row + a)), ids.take(pa.array(at)), pa.array(score)], schema=arrow))
        return pa.concat_tables(out)

    schema = f"query {queries.schema['query'].dataType.simpleString()}, doc {vectors.schema['id'].dataType.simpleString()}, score double"
    scored = left.groupBy("m", "q").cogroup(right.groupBy("m", "q")).applyInArrow(met, schema)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def fuse(arms: list[tuple[DataFrame, float]], k: int) -> DataFrame:
    """query, doc, score, rank: weighted reciprocal rank fusion of ranked arms."""
    parts = [arm.select("query", "doc", (F.lit(weight) / (RRF_C + F.col("rank"))).alias("part")) for arm, weight in arms]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    summed = both.groupBy("query", "doc").agg(F.round(F.sum("part"), 9).alias("score"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    return summed.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def dedupe(candidates: DataFrame, keys: list[str], cap: int = CANDIDATE_CAP) -> DataFrame:
    """The best-ranked of equal candidates of each query, at most ``cap``; ``rank`` is made dense."""
    first = Window.partitionBy("query", *keys).orderBy("rank", "doc")
    kept = candidates.withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_k")
    order = Window.partitionBy("query").orderBy("rank", "doc")
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cap)


def collapse_to_parents(scored: DataFrame, parent: list[str], k: int) -> DataFrame:
    """The best child of each parent, the k best parents of each query."""
    best = Window.partitionBy("query", *parent).orderBy(F.desc("score"), "rank")
    kept = scored.withColumn("_k", F.row_number().over(best)).filter("_k = 1").drop("_k")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "rank")
    return kept.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """query, doc, rank_a, rank_b, status, delta: two rankings side by side."""
    both = a.select("query", "doc", F.col("rank").alias("rank_a")).join(b.select("query", "doc", F.col("rank").alias("rank_b")), ["query", "doc"], "full_outer")
    status = F.when(F.col("rank_b").isNull(), "only_in_a").when(F.col("rank_a").isNull(), "only_in_b").otherwise("in_both")
    return both.withColumn("status", status).withColumn("delta", F.col("rank_a") - F.col("rank_b"))


def recall_at(ranked: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """query, recall: share of expected documents among the k best."""
    hits = expected.join(ranked.filter(F.col("rank") <= k).select("query", "doc", F.lit(1).alias("hit")), ["query", "doc"], "left")
    return hits.groupBy("query").agg(F.round(F.count("hit") / F.count("*"), 6).alias("recall"))


def quoting(docs: DataFrame, items: DataFrame, n: int = 8) -> DataFrame:
    """query, doc: the documents (doc, text) that contain an item (query, item) as it stands; no empty item.

    Both are cut at white space, and the first whole words of an item, ``n`` at most, are looked for
    by an equi-join among all runs of as many words; only what has them is searched for the item. The first
    and the last word of an item may be parts of a document's, so they are left out; an item with
    nothing between them is held against every document, in blocks of the stated items.
    """
    words = F.split("item", r"\s+")
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    keyed = items.filter("item <> ''").select("query", "item", F.slice(inner, 1, n).alias("key")).withColumn("n", F.size("key"))
    long = keyed.filter("n > 0")
    lengths = [r["n"] for r in long.select("n").distinct().collect()]  # at most n of them
    runs = docs.select("doc", F.split("text", r"\s+").alias("w"))
    starts = F.explode(F.array(*(F.lit(k) for k in lengths))) if lengths else F.lit(0)
    placed = runs.select("doc", "w", starts.alias("n")).filter(F.size("w") >= F.col("n"))
    keys = placed.select("doc", "n", F.explode(F.expr("transform(sequence(1, size(w) - n + 1), i -> xxhash64(slice(w, i, n)))")).alias("h")) if lengths else placed.select("doc", "n", F.lit(0).cast("long").alias("h"))
    wanted = long.select("query", "n", F.xxhash64("key").alias("h"))
    small = wanted.count() <= BROADCAST_ITEMS  # then runs that no item begins with are not shuffled
    hit = keys.join(F.broadcast(wanted) if small else wanted, ["n", "h"]).select("query", "doc").distinct()
    sure = hit.join(long.select("query", "item"), "query").join(docs, "doc").filter(F.contains("text", "item")).select("query", "doc")
    short = keyed.filter("n = 0").select("query", "item")
    blocks = -(-short.count() // QUERY_BLOCK)
    for b in range(blocks):
        own = short.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b)
        sure = sure.unionByName(docs.join(F.broadcast(own), F.contains("text", "item")).select("query", "doc"))
    return sure.distinct()
