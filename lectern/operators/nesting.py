"""Terms of one to three words with the terms that contain them, as C-value needs them.

The terms of a batch of documents are counted where the documents are read, and go as numbers, packed with
their words, to the bucket of their first two words. There each different term is left once; it goes on to
the bucket of its last two words, so what surrounds a term of two words is known in one place. What
surrounds single words is summed up in each bucket and sent as sums. No term is shuffled as text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import grams

#: Tokens of a batch, and characters of text for each bucket, of which there are LEAST_BUCKETS at least.
BATCH_TOKENS, BUCKET_CHARS, LEAST_BUCKETS = 1 << 20, 1 << 24, 64
WORDS = 3
BLOCK = "bucket int, n int, n_words int, size long, data binary"


def blocks(words: np.ndarray, found: np.ndarray, counts: np.ndarray, bucket: np.ndarray) -> pa.Table:
    """A row for each bucket: its terms as numbers, their columns of ``counts``, and the words that the numbers mean."""
    order = np.argsort(bucket.astype(np.uint16) if not len(bucket) or bucket.max() < 1 << 16 else bucket, kind="stable")
    bucket, found, counts = bucket[order], np.ascontiguousarray(found[order].T) + 1, np.ascontiguousarray(counts[order].T)
    begin = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(order) else np.zeros(0, np.int64)
    codec, rows = pa.Codec("zstd"), []
    for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(order)], strict=True):
        used = np.zeros(len(words) + 1, bool)
        used[0] = True
        used[found[:, a:b]] = True
        listed = words[np.flatnonzero(used)[1:] - 1].tolist()
        place = (np.cumsum(used) - 1).astype(code_type(len(listed)))
        data = place[found[:, a:b]].tobytes() + counts[:, a:b].tobytes() + "\n".join(listed).encode()
        rows.append((int(bucket[a]), b - a, len(listed), len(data), codec.compress(data, asbytes=True)))
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "n", "n_words", "size", "data"])


def code_type(n_words: int) -> type:
    return np.uint16 if n_words < 1 << 16 else np.uint32


def merged(table: pa.Table, columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """words, terms, counts of a bucket's blocks; each term once, its counts summed up."""
    codec, texts, found, counts, before = pa.Codec("zstd"), [], [], [], 0
    for n, n_words, size, data in zip(*(table.column(c).to_pylist() for c in ("n", "n_words", "size", "data")), strict=True):
        raw = codec.decompress(data, size, asbytes=True)
        kind = np.dtype(code_type(n_words))
        end = WORDS * n * kind.itemsize
        codes = np.frombuffer(raw, kind, WORDS * n).reshape(WORDS, n).astype(np.int32)
        codes += np.where(codes > 0, np.int32(before), np.int32(0))
        found.append(codes)
        counts.append(np.frombuffer(raw, np.int64, columns * n, end).reshape(columns, n))
        texts += raw[end + 8 * columns * n :].decode().split("\n") if n_words else []
        before += n_words
    coded = pa.array(texts, pa.string()).dictionary_encode()
    words = np.array(coded.dictionary.to_pylist(), object)
    place = np.append(np.int32(-1), coded.indices.to_numpy().astype(np.int32))
    return words, *summed(len(words), place[np.concatenate(found, axis=1)].T, np.concatenate(counts, axis=1).T)


def summed(n_words: int, found: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each term once, its counts summed up; without any, how often it stands there."""
    key = grams.packed(found, n_words)
    if len(key) > 1:
        order, begin = grams.runs(*key)
        found = found[order[begin]]
    elif counts is None:
        key = np.sort(key[0])
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        bits = int(n_words + 1).bit_length()
        found = np.stack([(key[begin] >> bits * k) & ((1 << bits) - 1) for k in range(WORDS - 1, -1, -1)], axis=1).astype(np.int32) - 1
        return found, np.diff(np.append(begin, len(key)))[:, None]
    else:
        order = np.argsort(key[0])
        key = key[0][order]
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        found = found[order[begin]]
    if counts is None:
        return found, np.diff(np.append(begin, len(order)))[:, None]
    return found, np.add.reduceat(counts[order], begin, axis=0) if len(begin) else counts


def dealt(words: np.ndarray, first: np.ndarray, second: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of two words, the second -1 where there is none."""
    own = np.append(pd.util.hash_array(words, hash_key=grams.KEYS[0], categorize=False), np.uint64(1)) if len(words) else np.ones(1, np.uint64)
    h = (own[first] * grams.MIX[0]) ^ (own[second] + grams.MIX[2])
    h = (h ^ (h >> np.uint64(29))) * grams.MIX[1]
    return ((h ^ (h >> np.uint64(32))) % np.uint64(buckets)).astype(np.int32)


def around(found: np.ndarray, freq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row for each single word of each of the different terms of two or three: the word, and 0, 1 and the term's frequency."""
    longer = found[:, 1] >= 0
    found, freq = found[longer], freq[longer]
    x, y, z = found.T
    fresh = [np.ones(len(x), bool), y != x, (z >= 0) & (z != x) & (z != y)]
    word = np.concatenate([c[ok] for c, ok in zip((x, y, z), fresh, strict=True)])
    return alone(word), beside(np.concatenate([freq[ok] for ok in fresh]))


def alone(*columns: np.ndarray) -> np.ndarray:
    """Terms of the words of ``columns``, filled up with -1."""
    return np.stack([*columns, *[np.full(len(columns[0]), -1, columns[0].dtype)] * (WORDS - len(columns))], axis=1)


def beside(freq: np.ndarray) -> np.ndarray:
    return np.stack([np.zeros(len(freq), np.int64), np.ones(len(freq), np.int64), freq], axis=1)


def nested(docs: DataFrame, stopwords: Sequence[str], id_col: str = "doc_id", text_col: str = "text", min_chars: int = 3) -> DataFrame:
    """term, freq, words, mean: every term with its frequency, its number of words, and the mean frequency of the terms that contain it, null without any."""
    n_chars = docs.agg(F.sum(F.length(text_col).cast("long"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, n_chars // BUCKET_CHARS)

    def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for _, lists in grams.listed(b.column(0), BATCH_TOKENS):
                codes, words = grams.numbered(lists)
                _, found = grams.placed(pc.list_value_length(lists).to_numpy(), codes, words, stopwords, WORDS, min_chars)
                found, freq = summed(len(words), found)
                yield from blocks(words, found, freq, dealt(words, found[:, 0], found[:, 1], buckets)).to_batches()

    def once(table: pa.Table) -> pa.Table:
        words, found, freq = merged(table, 1)
        freq = freq[:, 0]
        three = found[:, 2] >= 0
        own = np.stack([freq, np.zeros_like(freq), np.zeros_like(freq)], axis=1)
        single, singles = around(found, freq)
        lead = alone(found[three, 0], found[three, 1])
        short, counts = summed(len(words), np.concatenate([found[~three], lead, single]), np.concatenate([own[~three], beside(freq[three]), singles]))
        found, counts = np.concatenate([short, found[three]]), np.concatenate([counts, own[three]])
        longest = found[:, 2] >= 0
        bucket = dealt(words, np.where(longest, found[:, 1], found[:, 0]), np.where(longest, found[:, 2], found[:, 1]), buckets)
        return blocks(words, found, counts, bucket)

    def finish(table: pa.Table) -> pa.Table:
        words, found, counts = merged(table, 3)
        three = found[:, 2] >= 0
        tail = alone(found[three, 1], found[three, 2])
        found, counts = summed(len(words), np.concatenate([found, tail]), np.concatenate([counts, beside(counts[three, 0])]))
        known = counts[:, 0] > 0
        found, (freq, n, total) = found[known], counts[known].T
        mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
        text = grams.Terms(np.zeros(0), found, freq, words).every_text()
        return pa.table({"term": text, "freq": pa.array(freq), "words": pa.array((found >= 0).sum(axis=1).astype(np.int32)), "mean": mean})

    sent = docs.select(grams.folded(text_col).alias("w")).mapInArrow(send, BLOCK)
    each = sent.groupBy("bucket").applyInArrow(once, BLOCK)
    return each.groupBy("bucket").applyInArrow(finish, "term string, freq long, words int, mean double")
