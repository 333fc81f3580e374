"""Token output: equal-length sequences and masks in Arrow files, read back without copying.

Each shard is an Arrow IPC file whose record batches hold two fixed-size lists, ``input_ids`` and
``mask``. All documents of the shard stand one after the other, each with its end id; the stream is
cut into sequences of ``seq_len`` ids, and the last one is filled up with masked ids. A second file
has each document's identifier and length. With a memory map, a batch's values are one array
[sequences, seq_len] in place, so any sequence, document or batch can be read by its number alone.
"""

from __future__ import annotations

import contextlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import materialize, prepare, scratch_path, shuffle_width, tidy
from lectern.llm.tokens import encoder, vocabulary_path

#: Sequences of a record batch.
BATCH_SEQUENCES = 256


class ShardWriter:
    """Writes one shard; ids come in pieces of any length, and at most one batch of them is held."""

    def __init__(self, where: str, name: str, attempt: int, seq_len: int, small: bool) -> None:
        self.store, self.root = fs.FileSystem.from_uri(where)
        self.name, self.attempt, self.seq_len = name, attempt, seq_len
        self.kind = pa.uint16() if small else pa.uint32()
        self.schema = pa.schema([("input_ids", pa.list_(self.kind, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
        self.store.create_dir(self.root, recursive=True)
        self.out = self.store.open_output_stream(self._path("ids", True))
        self.file = pa.ipc.new_file(self.out, self.schema)
        self.held: list[bytes] = []
        self.size = self.tokens = 0
        self.ids: list[int | None] = []
        self.lengths: list[int] = []

    def _path(self, what: str, new: bool = False) -> str:
        return f"{self.root}/{self.name}.{what}.arrow" + f".{self.attempt}" * new

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.tokens += len(ids) // 4
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= 4 * self.seq_len * BATCH_SEQUENCES:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        flat = np.frombuffer(b"".join(self.held), "<u4")
        whole = -(-len(flat) // self.seq_len) if last else len(flat) // self.seq_len
        used = min(len(flat), whole * self.seq_len)
        values = np.zeros(whole * self.seq_len, self.kind.to_pandas_dtype())
        values[:used] = flat[:used]
        mask = np.zeros(len(values), bool)
        mask[:used] = True
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(v), self.seq_len) for v in (values, mask)]
        batch = pa.RecordBatch.from_arrays(lists, schema=self.schema)
        for at in range(0, whole, BATCH_SEQUENCES):
            self.file.write_batch(batch.slice(at, BATCH_SEQUENCES))
        self.held = [flat[used:].tobytes()]
        self.size = len(self.held[0])

    def close(self) -> None:
        """Finish both files under names of this attempt, then give them their own names."""
        self._flush(last=True)
        self.file.close()
        self.out.close()
        index = pa.table({"doc_id": pa.array(self.ids, pa.int64()), "n_tokens": pa.array(self.lengths, pa.int64())})
        with self.store.open_output_stream(self._path("docs", True)) as out, pa.ipc.new_file(out, index.schema) as file:
            file.write_table(index, max_chunksize=1 << 16)
        for what in ("docs", "ids"):
            self.store.move(self._path(what, True), self._path(what))


class ShardReader:
    """Random access to one shard."""

    def __init__(self, where: str, name: str) -> None:
        store, root = fs.FileSystem.from_uri(where)
        opened = (lambda p: pa.memory_map(p)) if isinstance(store, fs.LocalFileSystem) else store.open_input_file
        self.file = pa.ipc.open_file(opened(f"{root}/{name}.ids.arrow"))
        index = pa.ipc.open_file(opened(f"{root}/{name}.docs.arrow")).read_all()
        self.doc_ids = index.column("doc_id").to_pylist()
        self.lengths = index.column("n_tokens").to_numpy()
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.seq_len = self.file.schema.field("input_ids").type.list_size
        self._sizes = [self.file.get_batch(k).num_rows for k in range(self.file.num_record_batches)]
        self.firsts = np.concatenate([[0], np.cumsum(self._sizes)]).astype(np.int64)
        self._open: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint32))

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th batch as [sequences, seq_len], without copying."""
        if self._open[0] != k:
            self._open = (k, self.file.get_batch(k).column(0).flatten().to_numpy(zero_copy_only=True).reshape(-1, self.seq_len))
        return self._open[1]

    def batch(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and the mask of the k-th batch, both as [sequences, seq_len]."""
        return self.ids(k), self.file.get_batch(k).column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, self.seq_len)

    def sequence(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        k = int(np.searchsorted(self.firsts, n, side="right")) - 1
        ids, mask = self.batch(k)
        return ids[n - self.firsts[k]], mask[n - self.firsts[k]]

    def pieces(self, start: int, end: int) -> Iterator[np.ndarray]:
        """The ids from ``start`` to ``end`` of the shard's stream, a slice for each batch."""
        while start < end:
            k = int(np.searchsorted(self.firsts, start // self.seq_len, side="right")) - 1
            begin = int(self.firsts[k]) * self.seq_len
            flat = self.ids(k).reshape(-1)[start - begin : end - begin]
            yield flat
            start += len(flat)

    def document(self, n: int) -> np.ndarray:
        return np.concatenate([np.zeros(0, "<u4"), *self.pieces(int(self.starts[n]), int(self.starts[n + 1]))])


def write_tokens(
    docs: DataFrame,
    where: str,
    vocabulary: str | None = None,
    end_id: int = 0,
    seq_len: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Write all documents in ascending order of their identifier; shard, n_docs, n_tokens for each file.

    Rows are dealt by ranges of the identifier, so shard numbers follow its order; equal identifiers
    are ordered by their texts, null ones come first. A null or empty text has its end id alone. A
    task writes one shard under names of its attempt and renames them when complete, so a task that
    runs again leaves the same files. An empty table leaves no file.
    """
    spark = docs.sparkSession
    prepare(spark)
    path = vocabulary or vocabulary_path()
    end = end_id.to_bytes(4, "little")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, context = encoder(path), TaskContext.get()
        shard, writer = context.partitionId(), None
        for batch in it:
            ids, begin = encode.batch(batch.column(1))
            for doc_id, a, b in zip(batch.column(0).to_pylist(), begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                if writer is None:
                    writer = ShardWriter(where, f"shard-{shard:06d}", context.taskAttemptId(), seq_len, max(encode.vocabulary, end_id + 1) <= 1 << 16)
                writer.add(doc_id, ids[a:b].tobytes() + end)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (shard, len(writer.lengths), writer.tokens)], names=["shard", "n_docs", "n_tokens"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ranged = picked.repartitionByRange(max(8, shuffle_width(spark)), "doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(ranged.mapInArrow(tidy(run), "shard long, n_docs long, n_tokens long"), "shards")


def read_tokens(written: DataFrame, where: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 for every document, from the files alone.

    ``start`` counts the ids of all documents before it. One number for each shard passes the driver.
    """
    spark = written.sparkSession
    shards, at = [], 0
    for r in written.orderBy("shard").collect():
        shards.append((r["shard"], at))
        at += r["n_tokens"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for shard, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = ShardReader(where, f"shard-{shard:06d}")
                sums = []
                for start, end in zip(reader.starts[:-1].tolist(), reader.starts[1:].tolist(), strict=True):
                    crc = 0
                    for flat in reader.pieces(start, end):
                        crc = zlib.crc32(flat.astype("<u4").tobytes(), crc)
                    sums.append(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(reader.doc_ids, pa.int64()), pa.array(reader.starts[:-1] + before), pa.array(reader.lengths), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    todo = spark.createDataFrame(shards, "shard long, before long")
    width = min(max(1, len(shards)), 4 * max(1, spark.sparkContext.defaultParallelism))
    return todo.repartition(width).mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, where: str | None = None, **options: object) -> DataFrame:
    """Write the files (to the shared scratch folder unless told where) and read every document back."""
    where = where or scratch_path(docs.sparkSession, "tokens")
    with contextlib.suppress(AttributeError):
        where = where if "://" in where else f"file://{where}"
    return read_tokens(write_tokens(docs, where, **options), where)
