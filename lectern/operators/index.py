"""Sparse index and ranking: positional postings, BM25, scope, digests of the indexed set."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import subtokens, tokenize
from lectern.operators import scoring
from lectern.operators.scratch import materialize

# Parameters of the ranking function.
K1, B, MIN_IDF = 1.2, 0.75, 1e-6
#: A query set of at most so many token parts is broadcast to the postings; a longer one is joined by shuffle.
BROADCAST_PARTS = 200_000
#: Stands for the end of a text among its tokens.
END = "\n"


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, pos, term: one row for each token; feed it to a join with few terms, or count it."""
    return docs.select(F.col(id_col).alias("doc"), F.posexplode(subtokens(F.col(text_col))).alias("pos", "term"))


def doc_stats(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, dl: tokens of each document, without a shuffle."""
    return docs.select(F.col(id_col).alias("doc"), F.size(subtokens(F.col(text_col))).cast("long").alias("dl"))


def term_stats(docs: DataFrame, text_col: str) -> DataFrame:
    """term, tf, df from one pass: a text sends all its tokens and, marked, each different one once.

    Both are counted within a partition before the one shuffle, which holds a partition's vocabulary.
    """
    words = docs.select(subtokens(F.col(text_col)).alias("w"))
    both = words.select(F.explode(F.array(F.struct(F.col("w").alias("w"), F.lit(0).alias("d")), F.struct(F.array_distinct("w").alias("w"), F.lit(1).alias("d")))).alias("x"))
    each = both.select(F.col("x.d").alias("d"), F.explode("x.w").alias("term"))
    return each.groupBy("term").agg(F.sum(1 - F.col("d")).alias("tf"), F.sum("d").alias("df"))


def query_parts(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """query, phrase, weight, parts: every query token with how often it stands there, as a phrase of its parts."""
    tokens = queries.select(F.col(id_col).alias("query"), F.explode(tokenize(F.col(text_col))).alias("phrase"))
    weighted = tokens.groupBy("query", "phrase").agg(F.count("*").alias("weight"))
    return weighted.withColumn("parts", F.filter(F.split("phrase", "[./]"), lambda t: t != ""))


def phrase_parts(phrases: DataFrame) -> DataFrame:
    """phrase, n_parts, i, term."""
    return phrases.select("phrase", F.size("parts").alias("n_parts"), F.posexplode("parts").alias("i", "term")).distinct()


def phrase_counts(found: DataFrame) -> DataFrame:
    """phrase, doc, dl, tf: how often each phrase stands in each document, from the postings of its parts.

    A phrase of one part is counted as it is; one of several stands where all its parts do.
    """
    start = F.when(F.col("n_parts") > 1, F.col("pos") - F.col("i"))
    starts = found.groupBy("phrase", "n_parts", "doc", "dl", start.alias("start")).agg(F.count("*").alias("k"))
    tf = F.when(F.col("n_parts") == 1, F.col("k")).when(F.col("k") == F.col("n_parts"), F.lit(1))
    return starts.groupBy("phrase", "doc", "dl").agg(F.sum(tf).alias("tf")).filter("tf > 0")


def rank_postings(found: DataFrame, phrases: DataFrame, totals: DataFrame, k: int, scope: DataFrame | None = None) -> DataFrame:
    """query, doc, score, rank from postings of the query's parts (phrase, n_parts, i, term, doc, dl, pos).

    ``totals`` has n_docs and avgdl; ``scope``, a table of documents, limits the candidates before the cut.
    """
    counts = phrase_counts(found)
    df = counts.groupBy("phrase").agg(F.count("*").alias("df"))
    n, d = F.col("n_docs"), F.col("df")
    raw = F.log((n - d + 0.5) / (d + 0.5))
    idf = df.crossJoin(F.broadcast(totals)).select("phrase", "avgdl", F.when(raw > 0, raw).otherwise(MIN_IDF).alias("idf"))
    if scope is not None:
        counts = counts.join(scope, "doc", "left_semi")
    tf, dl = F.col("tf"), F.col("dl")
    part = F.col("weight") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("avgdl")))
    scored = counts.join(idf, "phrase").join(phrases.select("query", "phrase", "weight"), "phrase")
    scored = scored.groupBy("query", "doc").agg(F.round(F.sum(part), 6).alias("score"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def rank_documents(found: DataFrame, known: scoring.Phrases, totals: DataFrame, k: int, query_type: str, inside: Column | None = None) -> DataFrame:
    """query, doc, score, rank of documents (doc, dl, ids, tfs), the phrases of each by number; ``inside`` limits the candidates before the cut."""
    n, avgdl = totals.select("n_docs", "avgdl").first()
    df = np.zeros(len(known.names))
    for p, count in found.select(F.explode("ids").alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect():  # as many as the queries have phrases
        df[p] = count
    with np.errstate(divide="ignore", invalid="ignore"):
        raw = np.log((n - df + 0.5) / (df + 0.5))
    return scoring.best(found if inside is None else found.filter(inside), known, np.where(raw > 0, raw, MIN_IDF), avgdl or 1.0, k, K1, B, query_type)


def bm25(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text", query_col: str = "item_id", query_text: str = "text", scope: Column | None = None) -> DataFrame:
    """query, doc, score, rank: the k best documents of each query, without a stored index.

    The texts are read and cut into tokens once: what is kept of them, the queries' phrases in each document
    and its length, is written to the shared folder and ranked from there (``scoring``). For a query set
    too long to be sent to every task it is postings, which are joined and ranked by shuffle.
    Statistics are those of all documents; ``scope``, a condition on documents, only limits the
    candidates, before the cut. Score and order are taken at six decimals, ties by document.
    """
    phrases = query_parts(queries, query_col, query_text)
    parts = phrase_parts(phrases)
    small = parts.count() <= BROADCAST_PARTS
    if small:
        inside = F.lit(True) if scope is None else F.coalesce(scope, F.lit(False))
        known = scoring.numbered(phrases)
        words = docs.select(F.col(id_col).alias("doc"), inside.alias("inside"), subtokens(F.col(text_col)).alias("w"))
        found = materialize(scoring.counted(words, known), "found")
        totals = found.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
        return rank_documents(found, known, totals, k, phrases.schema["query"].dataType.simpleString(), F.col("inside"))
    # the end of a text is one more token, which no query has; its position is the length
    end = docs.sparkSession.range(1).select(F.lit(None).cast("string").alias("phrase"), F.lit(0).alias("n_parts"), F.lit(0).alias("i"), F.lit(END).alias("term"))
    wanted = parts.unionByName(end)
    words = docs.select(F.col(id_col).alias("doc"), subtokens(F.col(text_col)).alias("w"))
    every = words.select("doc", F.size("w").cast("long").alias("dl"), F.posexplode(F.array_append("w", F.lit(END))).alias("pos", "term"))
    found = materialize(every.join(wanted, "term"), "postings")
    lengths = found.filter(F.col("term") == END)
    totals = lengths.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    inside = None if scope is None else docs.filter(scope).select(F.col(id_col).alias("doc"))
    return rank_postings(found.filter(F.col("term") != END), phrases, totals, k, inside)


def index_fingerprint(ids: Column) -> Column:
    """Four sums of the 32-bit parts of the identifiers' digests: the same for any order."""
    digest = F.sha2(ids.cast("string"), 256)
    return F.struct(*(F.sum(F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long")).alias(f"s{k}") for k in range(4)), F.count("*").alias("n"))


def set_digest(hashes: DataFrame, prefix: int = 4) -> DataFrame:
    """digest, n of the distinct values of ``h`` (hexadecimal), whatever their order.

    The sorted values of each prefix are digested in parallel, and then those digests in the order of
    the prefixes: at most 16 ** prefix of them meet in one task, however many values there are.
    """
    each = hashes.select("h").distinct().groupBy(F.substring("h", 1, prefix).alias("prefix"))
    parts = each.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("d"), F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("prefix", "d")))["d"]
    return parts.agg(F.sha2(F.array_join(ordered, "\n"), 256).alias("digest"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
