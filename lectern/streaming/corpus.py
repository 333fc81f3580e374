"""Ingest of a folder as one stateful job: files in, a registry and a searchable index out.

A run lists the files below a root, without their content, and feeds the list to a stream that holds a
state for each path: when the file was changed, how long it is, and in which run it was last seen. What
comes out are changes: added, changed, and, by a timer that a path's next sighting moves on, removed.
States are kept by RocksDB, so there may be more of them than fit in memory. Each batch of changes reads
the content of the added and changed files alone, writes the registry's rows for them, and brings the
index up to date.

Everything may be broken off and run again: the stream goes on from its log, a batch that is repeated
overwrites its own registry rows, and the index takes no document twice. A file that cannot be read has a
registry row with its error, and no document; files of equal content are one document, which goes with
the last of them. Files of no bytes are not listed by Spark's source, and so are not there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lectern.functions.text import doc_hash
from lectern.operators import store
from lectern.operators.registry import FORMATS, suffix
from lectern.operators.scratch import materialize
from lectern.sources.files import extract

SCANS = "path string, modified long, size long, run long, at timestamp"
CHANGES = "path string, action string, modified long, size long, run long"
REGISTRY = "path string, action string, modified long, size long, run long, doc_hash string, doc long, error string, batch long"
#: A path that every run sees, so that time goes on where all files are gone.
HEARTBEAT = ""
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Paths(StatefulProcessor):
    """The state of one path. Runs are a second of event time apart; a path's timer stands half a second after the run that saw it last."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "modified long, size long, run long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803 - names of the interface
        modified, size, run = max((tuple(map(int, r)) for part in rows for r in part[["modified", "size", "run"]].itertuples(index=False)), key=lambda r: r[2])
        known = self.seen.get() if self.seen.exists() else None
        if known is not None and known[2] >= run:
            return
        self.seen.update((modified, size, run))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(run * 1000 + 500)
        if key[0] != HEARTBEAT and (known is None or (known[0], known[1]) != (modified, size)):
            yield pd.DataFrame([(key[0], "added" if known is None else "changed", modified, size, run)], columns=["path", "action", "modified", "size", "run"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        modified, size, run = self.seen.get()
        self.seen.clear()
        if key[0] != HEARTBEAT:
            yield pd.DataFrame([(key[0], "removed", modified, size, run + 1)], columns=["path", "action", "modified", "size", "run"])

    def close(self) -> None:
        pass


def document(digest: Column) -> Column:
    """The identifier of a content in the index: the first 60 bits of its digest."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def files(spark: SparkSession, root: str) -> DataFrame:
    """Files below ``root`` of formats that can be named, as Spark's binaryFile source gives them; no files where there is no such folder."""
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    except AnalysisException:
        return spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    return found.filter(suffix(F.col("path")).isin(*FORMATS))


def registry_rows(spark: SparkSession, where: str) -> DataFrame:
    try:
        return spark.read.schema(REGISTRY).option("recursiveFileLookup", "true").parquet(f"{where}/registry")
    except AnalysisException:
        return spark.createDataFrame([], REGISTRY)


def registry(spark: SparkSession, where: str, before: int | None = None) -> DataFrame:
    """REGISTRY of every path that is there, or was before a batch: its last row."""
    columns = [c.split()[0] for c in REGISTRY.split(", ")]
    rows = registry_rows(spark, where)
    last = (rows if before is None else rows.filter(F.col("batch") < before)).groupBy("path").agg(F.max_by(F.struct(*(c for c in columns if c != "path")), F.struct("batch", "run")).alias("r"))
    return last.select("path", *(f"r.{c}" for c in columns if c != "path")).filter("action <> 'removed'")


def take(changes: DataFrame, batch: int, root: str, where: str) -> None:
    """Apply one batch of CHANGES: registry rows first, then the index."""
    spark = changes.sparkSession
    changes = materialize(changes, "changes")
    if changes.isEmpty():
        return
    read = changes.filter("action <> 'removed'")
    texts = extract(files(spark, root).join(read.select("path"), "path", "left_semi")).select("path", "text", "error")
    texts = materialize(texts.withColumn("doc_hash", F.when(F.trim("text") != "", doc_hash(F.col("text")))).withColumn("doc", document(F.col("doc_hash"))), "texts")
    before = registry(spark, where, batch).join(changes.select("path"), "path", "left_semi").select("doc").filter("doc IS NOT NULL").distinct()
    before = materialize(before, "before")
    rows = changes.join(texts.drop("text"), "path", "left").withColumn("batch", F.lit(batch).cast("long"))
    rows.select(*(c.split()[0] for c in REGISTRY.split(", "))).write.mode("overwrite").parquet(f"{where}/registry/batch_{batch}")
    gone = before.join(registry(spark, where).select("doc").filter("doc IS NOT NULL").distinct(), "doc", "left_anti")
    store.delete(spark, f"{where}/index", gone)
    store.fill(texts.filter("doc IS NOT NULL"), f"{where}/index", id_col="doc")


def ingest(spark: SparkSession, root: str, where: str, run: int) -> dict[str, int]:
    """Bring registry and index below ``where`` up to the files below ``root``; runs have ascending numbers. Says how many changes of each kind there were.

    The number of states and of open batches is bounded by the files; a list of files is never held by the driver.
    """
    at = F.timestamp_seconds(F.lit(run))
    listed = files(spark, root).select("path", F.unix_micros("modificationTime").alias("modified"), F.col("length").alias("size"))
    beat = spark.createDataFrame([(HEARTBEAT, 0, 0)], "path string, modified long, size long")
    listed.unionByName(beat).select("*", F.lit(run).cast("long").alias("run"), at.alias("at")).write.mode("overwrite").parquet(f"{where}/scans/run_{run}")
    options = {"spark.sql.streaming.stateStore.providerClass": PROVIDER}
    kept = {k: spark.conf.get(k, None) for k in options}
    try:
        for k, v in options.items():
            spark.conf.set(k, v)
        scans = spark.readStream.schema(SCANS).option("recursiveFileLookup", "true").parquet(f"{where}/scans")
        changes = scans.withWatermark("at", "0 seconds").groupBy("path").transformWithStateInPandas(Paths(), CHANGES, outputMode="Update", timeMode="EventTime")
        writing = changes.writeStream.foreachBatch(lambda df, batch: take(df, batch, root, where)).option("checkpointLocation", f"{where}/log").outputMode("update").trigger(availableNow=True).start()
        writing.awaitTermination()
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    counted = registry_rows(spark, where).filter(F.col("run") == run).groupBy("action").agg(F.count("*").alias("n"), F.count("error").alias("errors")).collect()
    return {r.action: r.n for r in counted} | {"error": sum(r.errors for r in counted)}
