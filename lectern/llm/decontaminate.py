"""Benchmark decontamination: an FM-index for each shard of the training documents.

Each task cuts its partition into shards of a few megabytes and indexes the words of each shard over
the alphabet of the benchmark's words; other words match nothing and are separators, as is each end
of a document, and runs between separators that are shorter than every test phrase cannot hold one
and are left out. All test phrases are searched backwards together, each occurrence is located by
sampled suffix positions, and the occurrences are merged into spans. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import ROW, batches_of, blobs, filtered, materialize, numbered, prepare, tidy, without_ids
from lectern.llm.fm_index import FMIndex

WINDOW = 13
#: A shard's rows and bytes of text at most, but for one batch.
SHARD_ROWS, SHARD_BYTES = 20_000, 3 << 20
#: The benchmark is searched for in parts of about so many bytes of text, and at the most one item more.
BENCHMARK_BYTES = 4 << 20
#: Occurrences that are located at once.
ROWS = 1 << 20
# A-Z are lower-cased; of ASCII, only letters and digits are in words, and all else stands between them.
LOWER = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in bytes(range(256)).lower())


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


class Phrases:
    """The windows of all items, each distinct one once, with the items that have it."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.items = [i for i, _ in items]
        rows, owner = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int64)]
        for k, (_, text) in enumerate(items):
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], np.int32)
            if len(ids):
                padded = np.concatenate([np.zeros(max(0, window - len(ids)), np.int32), ids])
                rows.append(np.lib.stride_tricks.sliding_window_view(padded, window))
                owner.append(np.full(len(rows[-1]), k))
        # a right-aligned row of word numbers for each different window; 0 stands before a short one
        self.matrix, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        pairs = np.unique(np.stack([which.reshape(-1), np.concatenate(owner)], axis=1), axis=0)
        self.first = np.searchsorted(pairs[:, 0], np.arange(len(self.matrix) + 1))
        self.owner = pairs[:, 1]
        self.lengths = (self.matrix > 0).sum(axis=1)
        self.shortest = int(self.lengths.min()) if len(self.lengths) else 0

    def owners(self, phrase: int) -> list[str]:
        return [self.items[k] for k in self.owner[self.first[phrase] : self.first[phrase + 1]].tolist()]


def occurrences(ids: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``ids``, phrase) of every occurrence; 0 stands for other words and between documents."""
    none = np.zeros(0, np.int64)
    if not len(phrases.lengths):
        return none, none
    known = np.concatenate([[False], ids > 0, [False]])
    starts, ends = np.flatnonzero(known[1:] & ~known[:-1]), np.flatnonzero(known[:-1] & ~known[1:])
    keep = ends - starts >= phrases.shortest
    starts, ends = starts[keep], ends[keep]
    if not len(starts):
        return none, none
    edge = np.zeros(len(ids) + 2, np.int64)
    edge[starts] += 1
    edge[ends + 1] -= 1  # the separator after a run stays with it
    source = np.flatnonzero(np.cumsum(edge)[: len(ids) + 1] > 0)
    text = np.append(ids, 0)[source]
    index = FMIndex(text, len(phrases.vocabulary) + 1)
    low, high = index.search(phrases.matrix, phrases.lengths)
    count = high - low
    places, which = [none], [none]
    ends = np.cumsum(count)
    for at in range(0, int(ends[-1]), ROWS):
        k = np.arange(at, min(at + ROWS, int(ends[-1])))
        phrase = np.searchsorted(ends, k, side="right")
        places.append(source[index.locate(low[phrase] + k - (ends - count)[phrase])])
        which.append(phrase)
    return np.concatenate(places), np.concatenate(which)


def scan_shard(texts: list[bytes], phrases: Phrases) -> list[tuple[int, list[int], list[int], list[str]]]:
    """(words, starts and ends of the merged spans in words, sorted items) of each text."""
    parts, begins, at = [], [], 0
    get = phrases.vocabulary.get
    counts = []
    for text in texts:
        words = words_of(text)
        ids = np.fromiter(map(get, words, repeat(0)), np.int64, len(words))
        parts += [ids, np.zeros(1, np.int64)]
        begins.append(at)
        counts.append(len(words))
        at += len(words) + 1
    place, phrase = occurrences(np.concatenate(parts) if parts else np.zeros(0, np.int64), phrases)
    edge = np.zeros(at + 1, np.int64)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + phrases.lengths[phrase] if len(place) else place, -1)
    covered = np.concatenate([[False], np.cumsum(edge)[:at] > 0, [False]])
    starts, ends = np.flatnonzero(covered[1:] & ~covered[:-1]), np.flatnonzero(covered[:-1] & ~covered[1:])
    spans: list[tuple[list[int], list[int]]] = [([], []) for _ in texts]
    doc_of = np.searchsorted(begins, starts, side="right") - 1 if len(starts) else starts
    for d, a, b in zip(doc_of.tolist(), starts.tolist(), ends.tolist(), strict=True):
        spans[d][0].append(a - begins[d])
        spans[d][1].append(b - begins[d])
    items: list[set[str]] = [set() for _ in texts]
    if len(place):
        pairs = np.unique((np.searchsorted(begins, place, side="right") - 1) * len(phrases.lengths) + phrase)
        for d, w in zip((pairs // len(phrases.lengths)).tolist(), (pairs % len(phrases.lengths)).tolist(), strict=True):
            items[d].update(phrases.owners(w))
    return [(n, *s, sorted(i)) for n, s, i in zip(counts, spans, items, strict=True)]


def removal_spans(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """doc_id, n_words, starts, ends, items for every row: merged spans in words, and the items found.

    A null text has no words; an item without words, or with a null identifier, is not searched for.
    Repeated rows each get a row; other columns are not read. Whole texts are searched. A task holds
    one part of the benchmark, of about BENCHMARK_BYTES; a larger benchmark is searched for part by
    part, and what the parts find in a row is merged.
    """
    prepare(docs.sparkSession)
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text")).filter("item IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // BENCHMARK_BYTES)
    if parts <= 1:
        return search_part(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), items, window)
    rows = numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    items = materialize(items.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(parts))), "items")
    found = None
    for part in range(parts):
        one = search_part(rows.select(F.col(ROW).alias("doc_id"), "text"), items.filter(F.col("part") == part), window)
        one = materialize(one.filter(F.size("starts") > 0) if part else one, "spans")  # the first part has a row for each
        found = one if found is None else found.unionByName(one)
    flat = [F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "items")]
    whole = found.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), *flat).withColumnRenamed("doc_id", ROW)
    return whole.join(rows.select(ROW, "doc_id"), ROW).select("doc_id", "n_words", "starts", "ends", "items").mapInArrow(tidy(merge_spans), SPANS)


SPANS = "doc_id long, n_words long, starts array<long>, ends array<long>, items array<string>"


def merge_spans(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the spans of several parts: the maximal runs that they cover, and each item once."""
    for batch in it:
        starts, ends = [], []
        for first, after in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            spans: list[list[int]] = []
            for a, b in sorted(zip(first, after, strict=True)):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(b, spans[-1][1])
                else:
                    spans.append([a, b])
            starts.append([s[0] for s in spans])
            ends.append([s[1] for s in spans])
        listed = [sorted(set(i)) for i in batch.column(4).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(listed, pa.list_(pa.string()))], names=batch.schema.names)


def search_part(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """``removal_spans`` of doc_id, text for one part of the items (item, text), which every task holds."""
    phrases = Phrases([(r["item"], r["text"].encode()) for r in items.collect()], window)
    shared = docs.sparkSession.sparkContext.broadcast(phrases)
    kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches_of(it, SHARD_ROWS, SHARD_BYTES):
            rows = scan_shard(blobs(table.column(1)), shared.value)
            cols = list(zip(*rows, strict=True)) or [()] * 4
            out = pa.table([table.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_words", "starts", "ends", "items"])
            yield from out.combine_chunks().to_batches()

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), SPANS)


def judge(spans: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: a twentieth of the words hit, or more."""
    hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    out = spans.withColumn("n_hit", hit)
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns; each row is judged by itself.

    A benchmark of one part is searched for and judged in one pass; a larger one needs the rows numbered.
    """
    prepare(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).filter("item IS NOT NULL AND text IS NOT NULL")
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= BENCHMARK_BYTES:
        shared = docs.sparkSession.sparkContext.broadcast(Phrases([(r["item"], r["text"].encode()) for r in items.collect()], window))

        def clean(texts: pa.Array) -> list[bool]:
            hits = ((n, sum(ends) - sum(starts)) for n, starts, ends, _ in scan_shard(blobs(texts), shared.value))
            return [hit == 0 or 20 * hit < n for n, hit in hits]

        return filtered(docs, "text", lambda: clean, SHARD_ROWS, SHARD_BYTES)
    rows = numbered(docs)
    found = judge(removal_spans(rows.select(F.col(ROW).alias("doc_id"), "text"), benchmark)).filter("contaminated")
    return without_ids(rows, found.select(F.col("doc_id").alias(ROW)), ROW).drop(ROW)


def cut_out(text: str, starts: list[int], ends: list[int]) -> str:
    """``text`` without the words of the spans, and without what stands between words of one span."""
    raw = text.encode()
    plain = raw.translate(LOWER)
    at, places = 0, []
    for word in plain.split():
        at = plain.index(word, at)
        places.append((at, at + len(word)))
        at += len(word)
    out, at = [], 0
    for a, b in zip(starts, ends, strict=True):
        out.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, raw[at:]]).decode()
