"""Exact dedup: a tree merge of sorted digest runs.

Every input partition sorts its digests into a run with one entry for each distinct text. Partitions
then exchange runs in binomial rounds: nodes are numbered 0 .. P-1 (P a power of ``FAN_IN``), and in
round r each node keeps the part of its run whose digest has its own r-th digit and sends the others
to the partners that differ from it in that digit alone. A node merges the sorted runs it receives
(multiway) and keeps, for each verified digest, the winning identifier and the number of rows. After
log(P) rounds each node holds the finished run of its share of the digest space, so no task ever
gets more than a share, and a group of copies is one entry a node from the first round on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import ROW_KEY, blobs, join_sized, materialize, prepare, row_keys, shuffle_width, tidy, tidy_group, without_rows

#: Partners that meet in a round: 2 ** FAN_BITS.
FAN_BITS = 3
#: Entries of a run held in memory at once; a partition with more gives several runs.
RUN_ROWS = 500_000
KEY = ["d0", "d1", "d2", "d3", "n_bytes"]
RUN = "node long, d0 long, d1 long, d2 long, d3 long, n_bytes long, keep_id long, group_size long, named long"


def ascii_lower(text: bytes) -> bytes:
    """Lower-case A-Z and nothing else."""
    return text.lower()


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and the SHA-256 of the normalised text as four longs, with its length in bytes; columns of longs named in ``more`` are carried along."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = [ascii_lower(t) for t in blobs(batch.column(1))]
            raw = b"".join(hashlib.sha256(t).digest() for t in texts)
            words = np.frombuffer(raw, ">i8").astype(np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(words[:, k]) for k in range(4)), pa.array([len(t) for t in texts], pa.int64()), *batch.columns[2:]],
                names=["doc_id", *KEY, *more],
            )

    prepare(docs.sparkSession)
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)
    return picked.mapInArrow(tidy(run), ", ".join(f"{c} long" for c in ("doc_id", *KEY, *more)))


def merge_runs(table: pa.Table, largest: bool) -> pa.Table:
    """Merge sorted runs that stand one after the other; one entry for each verified digest.

    The stable sort finds the ascending runs and merges them. Entries with an equal first word are
    the same text only if the other words and the length agree too; should they ever differ, the
    run is sorted by all of them.
    """
    sums = [k for k in ("group_size", "named") if k in table.column_names]
    cols = {k: table.column(k).to_numpy() for k in (*KEY, "keep_id", *sums)}
    order = np.argsort(cols["d0"], kind="stable")
    same = np.ones(max(0, len(order) - 1), bool)
    verified = same.copy()
    for k in KEY:
        equal = cols[k][order][1:] == cols[k][order][:-1]
        verified &= equal
        if k == "d0":
            same = equal
    if (same & ~verified).any():
        order = np.lexsort([cols[k] for k in reversed(KEY)])
        verified = np.ones(len(order) - 1, bool)
        for k in KEY:
            verified &= cols[k][order][1:] == cols[k][order][:-1]
    first = np.flatnonzero(np.concatenate([[True], ~verified])) if len(order) else np.zeros(0, int)
    out = {k: cols[k][order][first] for k in KEY}
    if len(first):
        out["keep_id"] = (np.maximum if largest else np.minimum).reduceat(cols["keep_id"][order], first)
        out |= {k: np.add.reduceat(cols[k][order], first) for k in sums}
    else:
        out |= {k: np.zeros(0, np.int64) for k in ("keep_id", *sums)}
    return pa.table(out)


def node_of(bits: int) -> Column:
    """The node that a digest ends at: its topmost bits."""
    return F.shiftrightunsigned("d0", 64 - bits)


def tree_merge(digested: DataFrame, largest: bool) -> DataFrame:
    """d0 .. d3, n_bytes, keep_id, group_size: one row for each distinct text.

    Rows without identifier count; keep_id is null only where no row of the text has one.
    """
    spark = digested.sparkSession
    width = max(2 * shuffle_width(spark), digested.rdd.getNumPartitions(), 2)
    rounds = 1
    while 1 << (FAN_BITS * rounds) < width:
        rounds += 1
    loser = int(np.iinfo(np.int64).min if largest else np.iinfo(np.int64).max)
    nodes, digit = 1 << (FAN_BITS * rounds), (1 << FAN_BITS) - 1

    def local_runs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = TaskContext.get().partitionId() % nodes
        held: list[pa.Table] = []

        def run() -> Iterator[pa.RecordBatch]:
            one = merge_runs(pa.concat_tables(held), largest)
            yield from one.add_column(0, "node", pa.array(np.full(len(one), node, np.int64))).to_batches(10_000)

        for batch in it:
            one = pa.Table.from_batches([batch])
            one = one.rename_columns(["keep_id", *KEY]).append_column("group_size", pa.array(np.ones(len(one), np.int64)))
            one = one.append_column("named", pc.is_valid(one.column("keep_id")).cast(pa.int64()))
            one = one.set_column(0, "keep_id", pc.fill_null(one.column("keep_id"), loser))
            held.append(merge_runs(one, largest))
            if sum(map(len, held)) >= RUN_ROWS:
                yield from run()
                held = []
        if held:
            yield from run()

    def merge(table: pa.Table) -> pa.Table:
        one = merge_runs(table, largest)
        node = table.column("node")[0].as_py()
        return one.add_column(0, "node", pa.array(np.full(len(one), node, np.int64)))

    picked = digested.select("doc_id", *KEY)
    runs = picked.mapInArrow(tidy(local_runs), RUN)
    for r in range(rounds):
        mask = digit << (FAN_BITS * r)
        target = F.col("node").bitwiseAND(F.lit(~mask)).bitwiseOR(node_of(FAN_BITS * rounds).bitwiseAND(F.lit(mask)))
        runs = runs.withColumn("node", target).groupBy("node").applyInArrow(tidy_group(merge), RUN)
    return runs.withColumn("keep_id", F.when(F.col("named") > 0, F.col("keep_id"))).drop("node", "named")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", null_ids: bool = False) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row with an identifier, or with ``null_ids`` for every row.

    Texts are equal when identical after lower-casing A-Z only; a null text is an empty one. The row
    with the largest (or smallest) identifier of each group stays. Rows whose identifier is null
    have no row in the result and are not counted; with ``null_ids`` they are, never win, and their
    ``kept`` is null as in SQL, and so is ``keep_id`` where no row of the group has one. Rows that repeat an
    identifier each get a row. Other columns of ``docs`` are not read. An empty table gives none.
    """
    digested = materialize(digests(docs, id_col, text_col), "digests")
    digested = digested if null_ids else digested.filter(F.col("doc_id").isNotNull())
    winners = materialize(tree_merge(digested, keep == "largest"), "winners")
    joined = join_sized(digested, winners, KEY, "group_size")
    sha = F.lower(F.concat(*(F.lpad(F.hex(k), 16, "0") for k in KEY[:4])))
    return joined.select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), sha.alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one for each distinct text.

    It is decided by row: one without identifier stays only where none of its text has one, and of
    rows that repeat the winner's identifier one stays.
    """
    number = [F.col(c).cast("long").alias(c) for c in ROW_KEY]
    rows = row_keys(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id").select("id", "text", *number)
    digested = materialize(digests(rows, "id", "text", tuple(ROW_KEY)), "digests")
    winners = materialize(tree_merge(digested, keep == "largest"), "winners")
    copies = materialize(join_sized(digested, winners, KEY, "group_size").filter("group_size > 1"), "copies")
    own = F.struct(*ROW_KEY)
    stay = copies.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy(*KEY).agg(F.min(own).alias("own"), F.count("*").alias("k"))
    stay = materialize(stay.select("own.*", "k"), "stay")
    flag = F.col(ROW_KEY[1]).cast("boolean").alias(ROW_KEY[1])
    keys = [flag if c == ROW_KEY[1] else F.col(c) for c in ROW_KEY]
    gone = copies.select(*ROW_KEY).distinct().join(stay, ROW_KEY, "left_anti").select(*keys)
    return without_rows(docs, gone, stay.filter("k > 1").select(*keys), id_col, text_col)
