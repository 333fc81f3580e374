"""Best-fit packing by sums of squares.

Documents become sequences of at most ``capacity`` ids. Only longer documents are cut, into pieces of
``capacity`` ids, of which the first may be shorter. Pieces of full length are sequences by
themselves. Each other piece goes to the open bin, or a new one, for which the sum over all gaps g of
(number of open bins with g ids left) squared becomes smallest.

The pieces are dealt at random to shards of bounded size, longest first within each. Bins that stay
emptier than ``slack`` at the end of a shard are opened again, and their pieces are counted and dealt
anew to as many shards as they need. Where more than half of a round's pieces would go on, as when
too many are of one length to fit anywhere, one more round closes all its bins; so does a round of
one shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import materialize, prepare, tidy, tidy_group
from lectern.llm.tokens import encoder, vocabulary_path

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces of a shard, on average; they are dealt by hash.
SHARD_PIECES = 50_000
NEVER = np.iinfo(np.int64).max


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``length`` ids; the first takes the odd rest."""
    first = length % capacity or min(length, capacity)
    return [(0, first), *((at, capacity) for at in range(first, length, capacity))]


def pieces(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    prepare(docs.sparkSession)
    path, end = vocabulary or vocabulary_path(), end_id.to_bytes(4, "little")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in it:
            rows = []
            flat, begin = encode.batch(batch.column(1))
            for doc_id, a, b in zip(batch.column(0).to_pylist(), begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                ids = flat[a:b].tobytes() + end
                for k, (at, n) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((doc_id, k, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)])))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(tidy(run), PIECE)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each piece, gap of each bin), pieces in the given order; of equally good bins the fullest."""
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap; a full bin is open no more
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps: list[int] = []
    out = np.empty(len(lengths), np.int64)
    for k, n in enumerate(lengths.tolist()):
        # the change of the sum by the gap that is left; a full bin counts in no square
        change = 2 * (count[: capacity + 1 - n] - count[n:]) + 2
        change[0] = 1 - 2 * count[n]
        change[count[n:] == 0] = NEVER
        best = int(change.argmin())
        if change[best] <= 2 * count[capacity - n] * (n < capacity) + 1:
            bin_ = stacks[best + n].pop()
            count[best + n] -= 1
            left = best
        else:
            bin_, left = len(gaps), capacity - n
            gaps.append(0)
        gaps[bin_] = left
        if left:
            count[left] += 1
            stacks[left].append(bin_)
        out[k] = bin_
    return out, np.array(gaps, np.int64)


def placer(capacity: int, slack: int, level: int, last: bool) -> Callable[[pa.Table], pa.Table]:
    """Packs one shard; pieces of bins that go on to the next round have sequence -1."""

    def place(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")]))
        length = table.column("length").to_numpy()
        bins, gaps = sum_of_squares(length, capacity)
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(length[order])
        first = np.searchsorted(bins[order], np.arange(len(gaps)))
        before = np.concatenate([[0], ends])[first]
        offset = np.empty(len(length), np.int64)
        offset[order] = ends - length[order] - before[bins[order]]
        shard = table.column("shard")[0].as_py()
        kept = (gaps <= slack) | last
        number = np.where(kept[bins], bins + (np.int64(level) << 57) + (np.int64(shard) << 24), -1)
        return table.append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset))

    return place


def pack(cut_up: DataFrame, capacity: int = 1024, slack: int = 4) -> DataFrame:
    """The pieces with sequence_id and offset, their place; ``cut_up`` is a materialized table of pieces.

    Sequences are gapless from 0. Rows repeated in full are pieces of their own. An empty table gives none.
    """
    spark = cut_up.sparkSession
    whole = cut_up.filter(F.col("length") >= capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    todo = cut_up.filter(F.col("length") < capacity)
    left, done, level, last = todo.count(), [whole], 0, False
    placed = f"{PIECE}, shard long, sequence_id long, offset long"
    while True:
        shards = max(1, -(-left // SHARD_PIECES))
        last = last or shards == 1
        # the row's number keeps rows repeated in full, or without identifier, from meeting in one shard
        dealt = todo.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id(), F.lit(level)), F.lit(shards)))
        result = materialize(dealt.groupBy("shard").applyInArrow(tidy_group(placer(capacity, slack, level, last)), placed), f"packed{level}")
        done.append(result.filter(F.col("sequence_id") >= 0).drop("shard"))
        if last:
            break
        todo = result.filter(F.col("sequence_id") < 0).select("doc_id", "piece", "start", "length", "ids_crc32")
        before, left, level = left, todo.count(), level + 1
        if not left:
            break
        last = 2 * left > before
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def best_fit(docs: DataFrame, capacity: int = 1024, end_id: int = 2, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: where every piece of every document goes.

    A null or empty text is its end id alone. Whole texts are encoded, however long; a null
    identifier is carried along; repeated rows are packed each; other columns are not read.
    """
    cut_up = materialize(pieces(docs, vocabulary, end_id, capacity, id_col, text_col), "pieces")
    return pack(cut_up, capacity)
