"""Ranked lexical search by Block-Max WAND over an inverted index of fixed-size compressed blocks.

The index is a table: documents are dealt to segments as they are read, and a segment has one row for
its documents and one for each term, whose postings lie in blocks of BLOCK, each with its first and
last document, its maximum impact, and its offsets and counts in the fewest whole bytes.

A query reads only its terms' rows, a segment at a time. Pointers move over the blocks' ends and
maxima alone: a document's bound is the sum of the maxima of the blocks that span it, so a list whose
pointer stands behind it adds nothing. Documents whose bound is below the threshold, which is the
tenth best score that the task has met so far, are passed over, and blocks in which no other document
lies are never decompressed. The moves over a segment are made at once, as sums over its documents.
The rest is scored in full, those with the highest bounds first. Nothing is approximate.

Defined results: null and empty texts, and texts without a term, count nowhere. Every row is a
document by itself, also where identifiers repeat; a null identifier comes behind others of equal
score. Items that repeat a row with equal identifier and text are one query; with other texts, each
is. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import blobs, is_small, materialize, prepare, tidy

#: Fixed values of the contract: what a term is, and the numbers of the score.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOP = 10
#: Postings of a block; a segment ends at so many bytes of text or so many documents.
BLOCK, SEGMENT_BYTES, SEGMENT_DOCS = 128, 8 << 20, 1 << 16
#: Queries that are searched together; documents that are scored before the threshold is taken anew.
QUERY_BLOCK, FIRST = 1024, 256
#: Upper case becomes lower, and what is no term a space; bytes from 128 on belong to terms.
PLAIN = bytes(c if c >= 128 or chr(c) in LOWER + "0123456789" else c + 32 if chr(c) in UPPER else 32 for c in range(256))
WIDTHS = (np.dtype("u1"), np.dtype("<u2"), np.dtype("<u4"))
INDEX_SCHEMA = "segment long, term string, doc_ids array<long>, norms array<long>, df long, firsts binary, lasts binary, maxima binary, widths binary, payload binary"
_INDEX = pa.schema(
    [("segment", pa.int64()), ("term", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("norms", pa.list_(pa.int64())), ("df", pa.int64()), *((c, pa.binary()) for c in ("firsts", "lasts", "maxima", "widths", "payload"))]
)
_FOUND = pa.schema([("query", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
#: A null identifier is compared as this number, and told apart by a flag.
LAST = (1 << 63) - 1


def terms_of(text: Column) -> Column:
    """The terms of a text, in order."""
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))


def corpus_stats(docs: DataFrame) -> tuple[int, int]:
    """(documents with a term, terms of all documents)."""
    n = F.regexp_count(F.col("text").cast("string"), F.lit(TERM))
    n_docs, length = docs.agg(F.count(F.when(n > 0, 1)), F.sum(n.cast("long"))).first()
    return n_docs, length or 0


def impacts(tf: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * norms)


def width_of(largest: int) -> int:
    return 0 if largest < 1 << 8 else 1 if largest < 1 << 16 else 2


class _Segment:
    """The documents of a segment while it is built."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.norms: list[int] = []
        self.hits: list[int] = []
        self.terms: dict[str, int] = {}
        self.term_of: list[int] = []
        self.tf: list[int] = []
        self.size = 0

    def add(self, doc_id: int | None, counts: dict[bytes, int], norm: int, size: int) -> None:
        self.ids.append(doc_id)
        self.norms.append(norm)
        self.hits.append(len(counts))
        number = self.terms
        for term, tf in counts.items():
            self.term_of.append(number.setdefault(term, len(number)))
            self.tf.append(tf)
        self.size += size

    def rows(self, segment: int) -> Iterator[pa.RecordBatch]:
        """Rows of INDEX_SCHEMA, the documents first. Documents are numbered by ascending identifier."""
        order = sorted(range(len(self.ids)), key=lambda k: (self.ids[k] is None, self.ids[k] or 0))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        norms = np.array(self.norms, np.int64)[order]
        head = {"segment": segment, "doc_ids": [self.ids[k] for k in order], "norms": norms.tolist()}
        yield pa.RecordBatch.from_pylist([head], _INDEX)
        terms, tf = np.array(self.term_of, np.int64), np.array(self.tf, np.int64)
        docs = np.repeat(place, self.hits)
        by = np.lexsort((docs, terms))
        docs, tf = docs[by], tf[by]
        values = impacts(tf, norms[docs])
        ends = np.cumsum(np.bincount(terms, minlength=len(self.terms)))
        out: list[dict] = []
        for term, k in self.terms.items():
            a, b = int(ends[k - 1]) if k else 0, int(ends[k])
            cuts = np.arange(a, b, BLOCK)
            firsts, lasts = docs[cuts], docs[np.minimum(cuts + BLOCK, b) - 1]
            maxima, most = np.maximum.reduceat(values[a:b], cuts - a), np.maximum.reduceat(tf[a:b], cuts - a)
            widths, payload = bytearray(), []
            for c, first, last, top in zip(cuts.tolist(), firsts.tolist(), lasts.tolist(), most.tolist(), strict=True):
                w = width_of(last - first), width_of(top)
                widths += bytes(w)
                e = min(c + BLOCK, b)
                payload += [(docs[c:e] - first).astype(WIDTHS[w[0]]).tobytes(), tf[c:e].astype(WIDTHS[w[1]]).tobytes()]
            out.append({"segment": segment, "term": term.decode(), "df": b - a, "firsts": firsts.astype("<i4").tobytes(), "lasts": lasts.astype("<i4").tobytes(), "maxima": maxima.astype("<i4").tobytes(), "widths": bytes(widths), "payload": b"".join(payload)})
            if len(out) == 1000:
                yield pa.RecordBatch.from_pylist(out, _INDEX)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, _INDEX)


def index(docs: DataFrame, stats: tuple[int, int], terms: DataFrame | None = None) -> DataFrame:
    """INDEX_SCHEMA, as a table of the shared folder: every term of ``docs``, or those of ``terms`` (term), if they are few."""
    prepare(docs.sparkSession)
    n_docs, length = stats
    asked = {r.term.encode() for r in terms.collect()} if terms is not None and is_small(terms) else None

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, segment = TaskContext.get().partitionId(), 0, _Segment()
        for batch in it:
            for doc_id, blob in zip(batch.column(0).to_pylist(), blobs(batch.column(1)), strict=True):
                words = blob.translate(PLAIN).split()
                if not words:
                    continue
                counts = Counter(words)
                if asked is not None:
                    counts = {t: counts[t] for t in counts.keys() & asked}
                if counts:
                    segment.add(doc_id, counts, 10 + 90 * len(words) * n_docs // length, len(blob))
                if segment.size >= SEGMENT_BYTES or len(segment.ids) >= SEGMENT_DOCS:
                    yield from segment.rows((part << 32) + k)
                    k, segment = k + 1, _Segment()
        if segment.ids:
            yield from segment.rows((part << 32) + k)

    return materialize(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), INDEX_SCHEMA), "index")


class _List:
    """The postings of a term in a segment; blocks are decompressed when they are first needed, for all queries."""

    def __init__(self, row: dict, norms: np.ndarray) -> None:
        self.weight, self.df, self.payload, self.norms = row["weight"], row["df"], row["payload"], norms
        self.firsts, self.lasts = (np.frombuffer(row[c], "<i4").astype(np.int64) for c in ("firsts", "lasts"))
        self.maxima = np.frombuffer(row["maxima"], "<i4").astype(np.int64) * self.weight
        self.widths = np.frombuffer(row["widths"], np.uint8).reshape(-1, 2)
        sizes = np.full(len(self.firsts), BLOCK)
        sizes[-1] = self.df - BLOCK * (len(sizes) - 1)
        self.sizes, self.at = sizes, np.concatenate(([0], np.cumsum(sizes * (1 << self.widths.astype(np.int64)).sum(axis=1))))
        self.open = np.zeros(len(sizes), bool)
        self.docs, self.scores = np.zeros(self.df, np.int64), np.zeros(self.df, np.int64)

    def decompress(self, blocks: np.ndarray) -> None:
        for b in blocks[~self.open[blocks]].tolist():
            n, (wide, wide_tf), at, to = int(self.sizes[b]), self.widths[b], int(self.at[b]), b * BLOCK
            docs = np.frombuffer(self.payload, WIDTHS[wide], n, at).astype(np.int64) + self.firsts[b]
            tf = np.frombuffer(self.payload, WIDTHS[wide_tf], n, at + n * WIDTHS[wide].itemsize).astype(np.int64)
            self.docs[to : to + n], self.scores[to : to + n] = docs, self.weight * impacts(tf, self.norms[docs])
            self.open[b] = True

    def add(self, asked: np.ndarray, total: np.ndarray) -> None:
        """Add this term's scores to ``total`` for all documents of the blocks in which some of ``asked`` lie."""
        b = np.searchsorted(self.lasts, asked)
        inside = b < len(self.lasts)
        b = b[inside]
        blocks = np.unique(b[self.firsts[b] <= asked[inside]])
        self.decompress(blocks)
        if len(blocks) == len(self.sizes):
            total[self.docs] += self.scores
        elif len(blocks):
            at = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            at = at[at < self.df]
            total[self.docs[at]] += self.scores[at]


def search_segment(lists: list[_List], ids: np.ndarray, unnamed: np.ndarray, best: list[tuple[int, int, bool]]) -> None:
    """Update ``best``, the heap of (score, -identifier, named) of one query, by a segment's documents."""
    n = len(ids)
    firsts, lasts, maxima = (np.concatenate([getattr(x, name) for x in lists]) for name in ("firsts", "lasts", "maxima"))
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, firsts, maxima)
    np.add.at(change, lasts + 1, -maxima)
    bounds = np.cumsum(change[:n])
    left = np.flatnonzero(bounds > 0)
    total, size = np.zeros(n, np.int64), FIRST

    def passing(scores: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Which scores may still come among the best: at equal scores the smaller identifier does."""
        if len(best) < TOP:
            return scores > 0
        score, worst, _ = best[0]
        return (scores > score) | (scores == score) & (ids[docs] < -worst)

    while len(left := left[passing(bounds[left], left)]):
        asked = left
        if len(left) > 2 * size:
            high = np.argpartition(bounds[left], -size)[-size:]
            asked, rest = np.sort(left[high]), np.ones(len(left), bool)
            rest[high] = False
            left = left[rest]
        else:
            left = left[:0]
        total[:] = 0
        for x in lists:
            x.add(asked, total)
        asked = asked[passing(total[asked], asked)]
        for k in asked[np.lexsort((ids[asked], -total[asked]))][:TOP].tolist():
            entry = (int(total[k]), -int(ids[k]), not unnamed[k])
            if len(best) < TOP:
                heapq.heappush(best, entry)
            elif entry > best[0]:
                heapq.heapreplace(best, entry)
        size *= 4


def _searched(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best documents of each query over the segments of a partition, which is sorted by queries and segment."""
    best: dict[int, list[tuple[int, int, bool]]] = {}
    key, ids, unnamed, norms, lists = None, None, None, None, {}

    def finish() -> None:
        for query, own in lists.items():
            search_segment(own, ids, unnamed, best.setdefault(query, []))

    def found() -> pa.RecordBatch:
        rows = [(q, -d if named else None, s) for q, heap in best.items() for s, d, named in heap]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ((), (), ()), _FOUND.types, strict=True)], schema=_FOUND)

    for batch in it:
        for k in range(batch.num_rows):
            row = {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}
            if (row["block"], row["segment"]) != key:
                finish()
                if key is not None and row["block"] != key[0]:
                    yield found()
                    best = {}
                key, lists = (row["block"], row["segment"]), {}
            if row["term"] is None:
                ids, norms = np.array([LAST if x is None else x for x in row["doc_ids"]], np.int64), np.array(row["norms"], np.int64)
                unnamed = np.array([x is None for x in row["doc_ids"]])
                continue
            held = _List(row, norms)
            for query in row["queries"]:
                lists.setdefault(query, []).append(held)
    finish()
    yield found()


def query_terms(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query, item_id, text) and (query, term) of the items, as tables: equal rows are one query."""
    queries = items.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    queries = materialize(queries.select(F.monotonically_increasing_id().alias("query"), "item_id", "text"), "queries")
    return queries, materialize(queries.select("query", F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term")), "query-terms")


def search(indexed: DataFrame, stats: tuple[int, int], asked: DataFrame) -> DataFrame:
    """query, rank, doc_id, score: the TOP documents of each query of ``asked`` (query, term) in a table made by ``index``."""
    n_docs, _ = stats
    df = indexed.filter("term is not null").groupBy("term").agg(F.sum("df").alias("df"))
    n_queries = asked.select("query").distinct().count()
    n_blocks = max(1, -(-n_queries // QUERY_BLOCK))
    numbers = asked.select("query").distinct().select("query", F.pmod(F.xxhash64("query"), F.lit(n_blocks)).alias("block"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    wanted = asked.join(numbers, "query").groupBy("block", "term").agg(F.collect_list("query").alias("queries")).join(df, "term").select("block", "term", "queries", weight.cast("long").alias("weight"))
    wanted = materialize(wanted, "wanted")
    small = is_small(asked)
    lists = indexed.filter("term is not null").join(F.broadcast(wanted) if small else wanted, "term")
    heads = indexed.filter("term is null").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block"))
    columns = ["block", "segment", "term", "doc_ids", "norms", "df", "firsts", "lasts", "maxima", "widths", "payload", "queries", "weight"]
    heads = heads.select("*", F.lit(None).cast("array<long>").alias("queries"), F.lit(None).cast("long").alias("weight"))
    rows = heads.select(*columns).unionByName(lists.select(*columns)).repartition("block", "segment").sortWithinPartitions("block", "segment", F.col("term").isNotNull())
    found = rows.mapInArrow(tidy(_searched), "query long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.select("query", rank.alias("rank"), "doc_id", "score").filter(F.col("rank") <= TOP)


def ranked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score: the TOP documents of each item with a score above 0."""
    stats = corpus_stats(docs)
    queries, asked = query_terms(items)
    out = search(index(docs, stats, asked.select("term").distinct()), stats, asked)
    return queries.drop("text").join(out, "query").select("item_id", "rank", "doc_id", "score")
