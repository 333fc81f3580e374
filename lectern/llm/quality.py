"""Quality classifier: votes of the nearest labelled documents in a latent-semantic space.

A document is a row of hashed terms: its words, the shapes of its characters, and buckets of simple
proportions (distinct words, capitals, symbols, repeated lines ...). Terms are weighted by the
logarithm of their count and by their inverse document frequency over all documents. A truncated SVD
of a bounded sample of labelled rows gives the latent space. The sample's vectors are broadcast, and
each block of documents is multiplied with all of them: exact cosines, no index. The nearest
neighbours vote with their label, weighted by similarity.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import blobs, prepare, tidy

WORDS, SHAPES, BUCKETS, STATS = 2048, 2048, 16, 8
SIZE = WORDS + SHAPES + BUCKETS * STATS
BLOCKS = (slice(0, WORDS), slice(WORDS, WORDS + SHAPES), slice(WORDS + SHAPES, SIZE))
#: Documents of a block of cosine products.
BLOCK_ROWS = 512

_kind = np.zeros(256, np.int64)
for _c in range(256):
    _s = chr(_c)
    _kind[_c] = 1 if _c >= 128 else 2 if _s.islower() else 3 if _s.isupper() else 4 if _s.isdigit() else 5 if _s == " " else 6 if _s == "\n" else 7 + _c % 57


def proportions(raw: bytes, words: list[bytes], kinds: np.ndarray) -> list[float]:
    """STATS numbers from 0 to 1."""
    n, m = max(1, len(raw)), max(1, len(words))
    counts = np.bincount(kinds, minlength=64)
    lines = raw.split(b"\n")
    hashes = np.unique(np.fromiter(map(zlib.crc32, words), np.int64, len(words)), return_counts=True)[1]
    return [
        min(1.0, np.log2(1 + len(words)) / 16),
        len(hashes) / m,
        (hashes.max() if len(hashes) else 0) / m,
        counts[3] / n,
        counts[7:].sum() / n,
        counts[4] / n * 4,
        1 - len(set(lines)) / len(lines),
        min(1.0, n / m / 20),
    ]


def terms(texts: list[bytes]) -> np.ndarray:
    """Term counts, [document, SIZE]. The whole of each text is counted."""
    out = np.zeros((len(texts), SIZE), np.float32)
    for k, raw in enumerate(texts):
        kinds = _kind[np.frombuffer(raw, np.uint8)]
        words = raw.lower().split()
        if words:
            out[k, BLOCKS[0]] = np.bincount(np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % WORDS, minlength=WORDS)
        if len(kinds) > 3:
            gram = ((kinds[:-3] * 67 + kinds[1:-2]) * 67 + kinds[2:-1]) * 67 + kinds[3:]
            out[k, BLOCKS[1]] = np.bincount(gram * 2654435761 % 4294967291 % SHAPES, minlength=SHAPES)
        at = np.minimum(BUCKETS - 1, np.array(proportions(raw, words, kinds)) * BUCKETS).astype(np.int64)
        out[k, WORDS + SHAPES + np.arange(STATS) * BUCKETS + at] = 1
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Log counts times idf; each block of terms has length 1, so that none drowns another."""
    out = np.log1p(counts) * idf
    for block in BLOCKS:
        norm = np.linalg.norm(out[:, block], axis=1, keepdims=True)
        out[:, block] /= np.where(norm > 0, norm, 1)
    return out


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    axes: np.ndarray  # [SIZE, rank]
    vectors: np.ndarray  # [labelled, rank], of length 1
    labels: np.ndarray

    def project(self, counts: np.ndarray) -> np.ndarray:
        got = weighted(counts, self.idf) @ self.axes
        norm = np.linalg.norm(got, axis=1, keepdims=True)
        return got / np.where(norm > 0, norm, 1)

    def vote(self, counts: np.ndarray, neighbours: int, sharpness: float) -> np.ndarray:
        """Weighted share of label 1 among the nearest; the mean label where nothing is similar."""
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        cosine = self.project(counts) @ self.vectors.T
        k = min(neighbours, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.clip(np.take_along_axis(cosine, near, axis=1), 0, 1) ** sharpness
        total = weight.sum(axis=1)
        score = (weight * self.labels[near]).sum(axis=1) / np.where(total > 0, total, 1)
        return np.clip(np.where(total > 0, score, self.labels.mean()), 0, 1)


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many of all documents each term is, and their number; SIZE + 1 sums reach the driver."""
    prepare(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(SIZE + 1, np.int64)
        for batch in it:
            df[:SIZE] += (terms(blobs(batch.column(0))) > 0).sum(axis=0)
            df[SIZE] += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SIZE + 1, dtype=np.int32)), pa.array(df)], names=["term", "n"])

    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(tidy(run), "term int, n long")
    out = np.zeros(SIZE + 1, np.int64)
    for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out[:SIZE], int(out[SIZE])


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row's label must not be learned: crc32 of the identifier modulo 3 is 1."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_labelled: int = 3000,
    rank: int = 64,
) -> Model:
    """Learn from labelled rows that are not held out.

    Document frequencies are those of all documents. The space and the voters come from a sample of
    at most ``max_labelled`` rows, those whose identifiers have the smallest hashes; half of them
    for each label where there are enough. Labels other than 0 and 1, and null ones, are not used, nor
    are rows without identifier; one with several labels has the smaller one. Of documents that repeat
    an identifier each is a voter.
    """
    frequencies, total = document_frequencies(docs, text_col)
    idf = np.log((1 + total) / (1 + frequencies)).astype(np.float32) + 1
    usable = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    usable = usable.filter(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out("id"))
    usable = usable.groupBy("id").agg(F.min("label").alias("label")).withColumn("h", F.xxhash64(F.col("id").cast("string")))
    chosen = []
    for label in (0, 1):
        chosen += [(r["id"], r["label"]) for r in usable.filter(F.col("label") == label).orderBy("h", "id").limit(max_labelled // 2).collect()]
    picked = docs.sparkSession.createDataFrame(chosen, "id long, label int")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), "id")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = terms(blobs(batch.column(1)))  # float32: counts of long texts are beyond float16; most are 0, so they are sent compressed
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([zlib.compress(r.tobytes(), 1) for r in rows], pa.binary())], names=["id", "label", "terms"])

    got = sorted(texts.select("id", "text", "label").mapInArrow(tidy(run), "id long, label int, terms binary").collect(), key=lambda r: (r["id"], r["terms"]))
    counts = np.array([np.frombuffer(zlib.decompress(r["terms"]), np.float32) for r in got], np.float32).reshape(-1, SIZE)
    known = np.array([r["label"] for r in got], np.float32)
    return Model(idf, *latent(weighted(counts, idf), rank), known) if len(known) else Model(idf, np.zeros((SIZE, 0), np.float32), np.zeros((0, 0), np.float32), known)


def latent(rows: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """(axes, unit vectors of the rows) by subspace iteration from a fixed start."""
    base = np.random.default_rng(0).standard_normal((rows.shape[1], min(rank + 16, rows.shape[0]))).astype(np.float32)
    for _ in range(4):
        base = np.linalg.qr(rows.T @ (rows @ base))[0]
    _, _, right = np.linalg.svd(rows @ base, full_matrices=False)
    axes = (base @ right.T)[:, :rank].astype(np.float32)
    vectors = rows @ axes
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return axes, vectors / np.where(norm > 0, norm, 1)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", neighbours: int = 25, sharpness: float = 8.0) -> DataFrame:
    """doc_id, score for every row.

    A null text is an empty one; empty texts have terms too (no words, no lines) and are scored like
    any other. Whole texts are read; repeated rows each get a row; other columns are not read. With
    nothing learned every score is one half.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = blobs(batch.column(1))
            parts = [shared.value.vote(terms(texts[at : at + BLOCK_ROWS]), neighbours, sharpness) for at in range(0, len(texts), BLOCK_ROWS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.zeros(0), *parts]), pa.float64())], names=["doc_id", "score"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(tidy(run), "doc_id long, score double")
