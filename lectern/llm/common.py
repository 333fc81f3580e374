"""Helpers shared by the training-data operators: scratch tables, joins with hot keys, Arrow columns."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than 1 / HOT_SHARE of all rows, so at most HOT_SHARE keys can be hot.
HOT_SHARE = 1000
#: A table of a few numbers a row is broadcast up to so many rows (about 20 MB as a hash map), a longer one is joined by shuffle.
BROADCAST_ROWS = 1 << 18
#: Blocks from this size on are mapped by themselves, so that a worker gives them back when they are free.
MAPPED_BYTES = 4 << 20
_M_MMAP_THRESHOLD = -3
#: The column of row numbers, and those that tell rows apart by identifier and text.
ROW = "lectern_row"
ROW_KEY = ["lectern_id", "lectern_unnamed", "lectern_text0", "lectern_text1"]


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get: rows of text can be long."""
    for key, value in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", "1000"),
        ("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20)),
    ):
        try:
            spark.conf.set(key, value)
        except Exception:  # noqa: BLE001 - a release without the setting keeps its default
            continue


def release() -> None:
    """Give the worker's free memory back to the system; workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(_M_MMAP_THRESHOLD, MAPPED_BYTES)
        libc.malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over a partition, which leaves no free memory with the worker."""

    @wraps(run)
    def tidied(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        try:
            yield from run(it)
        finally:
            release()

    return tidied


def tidy_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``run`` over one group, which leaves no free memory with the worker."""

    @wraps(run)
    def tidied(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            release()

    return tidied


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the cluster's checkpoint folder, else one made for tests."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        where = "file://" + tempfile.mkdtemp(prefix="lectern-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends, any executor can be lost."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of what has been written out.

    It does so when the driver collects its garbage, which a driver with free memory puts off for long.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` as a table of the shared folder, with a number for each row: identifiers may be null or repeated."""
    return materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def row_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ROW_KEY: rows equal in it have the same identifier and text, and any of them stands for all."""
    identifier, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keys = (F.coalesce(identifier, F.lit(0)), identifier.isNull(), F.xxhash64(text), F.xxhash64(F.lit("second"), text))
    return docs.select("*", *(k.alias(name) for k, name in zip(keys, ROW_KEY, strict=True)))


def without_rows(docs: DataFrame, gone: DataFrame, repeated: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose key is not in ``gone``; of rows with a key in ``repeated`` one stays.

    Both are tables of ROW_KEY. Texts are written nowhere, and shuffled only where ``gone`` is long,
    or for the repeated rows themselves.
    """

    def held(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if is_small(table) else table

    gone, repeated = materialize(gone.select(*ROW_KEY), "gone"), materialize(repeated.select(*ROW_KEY).distinct(), "repeated")
    out = row_keys(docs, id_col, text_col).join(held(gone), ROW_KEY, "left_anti")
    if not repeated.isEmpty():
        once = out.join(held(repeated), ROW_KEY, "left_semi").dropDuplicates(ROW_KEY)
        out = out.join(held(repeated), ROW_KEY, "left_anti").unionByName(once)
    return out.drop(*ROW_KEY)


def filtered(docs: DataFrame, text_col: str, keep: Callable[[], Callable[[pa.Array], list[bool]]], rows: int = 1, size: int = 0) -> DataFrame:
    """The rows of ``docs`` that stay, with all columns, in one pass.

    ``keep`` is called once for each task and gives a function from texts to flags; it gets batches of
    ``rows`` rows or ``size`` bytes, or more.
    """
    at = docs.columns.index(text_col)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = keep()
        for table in batches_of(it, rows, size or 1):
            mask = pa.array(flags(table.column(at).combine_chunks()), pa.bool_())
            yield from table.filter(mask).to_batches()

    return docs.mapInArrow(tidy(run), docs.schema)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_sized(left: DataFrame, right: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row for each key and, in ``size``, the key's rows in ``left``.

    Keys with more than 1 / HOT_SHARE of all rows are at most HOT_SHARE many; they are broadcast,
    so no task gets a hot key's rows. All other keys are joined by shuffle. ``right`` should be a
    materialized table, as it is read three times.
    """
    total = right.agg(F.sum(size)).first()[0] or 0
    bound = F.lit(max(1, total // HOT_SHARE))
    hot = F.broadcast(right.filter(F.col(size) > bound))
    cold = right.filter(F.col(size) <= bound)
    return left.join(hot, keys).unionByName(left.join(hot.select(*keys), keys, "left_anti").join(cold, keys))


def is_small(ids: DataFrame) -> bool:
    """Whether a materialized table of a few numbers a row is short enough to broadcast."""
    return ids.count() <= BROADCAST_ROWS


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``docs`` whose identifier is not in ``ids``; texts are shuffled only where ``ids`` is long."""
    ids = materialize(ids, "ids")
    return docs.join(F.broadcast(ids) if is_small(ids) else ids, id_col, "left_anti")


def only_ids(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``docs`` whose identifier is in ``ids``, a materialized table."""
    return docs.join(F.broadcast(ids) if is_small(ids) else ids, id_col, "left_semi")


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blobs(column: pa.Array) -> list[bytes]:
    """The texts as bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def batches_of(it: Iterator[pa.RecordBatch], rows: int, size: int) -> Iterator[pa.Table]:
    """Tables of at least ``rows`` rows or ``size`` bytes, but for the last."""
    held: list[pa.RecordBatch] = []
    n = b = 0
    for batch in it:
        held.append(batch)
        n, b = n + batch.num_rows, b + batch.nbytes
        if n >= rows or b >= size:
            yield pa.Table.from_batches(held)
            held, n, b = [], 0, 0
    if n:
        yield pa.Table.from_batches(held)
