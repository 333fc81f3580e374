"""The document library: summaries, duplicates, upserts, classification of stored rows, conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import truncate


def summary(docs: DataFrame, *keys: str, size: str) -> DataFrame:
    """Counts and sums for each value of each key, and in all, from one pass."""
    grouped = docs.groupingSets([[k] for k in keys] + [[]], *keys)
    return grouped.agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n_docs"), F.coalesce(F.sum(size), F.lit(0)).alias("total"))


def duplicates(docs: DataFrame, id_col: str, digest: Column) -> DataFrame:
    """digest, n, first_doc of digests with more than one row; members stay where they are, so no group is gathered."""
    return docs.groupBy(digest.alias("digest")).agg(F.count("*").alias("n"), F.min(id_col).alias("first_doc")).filter("n > 1")


def upsert(stored: DataFrame, fresh: DataFrame, key: str, updated: list[str]) -> DataFrame:
    """``stored`` with the rows of ``fresh`` merged in by key: a match takes the non-null values of ``updated`` only,
    other fresh rows are added whole; ``event`` is reextract, extract or kept."""
    columns = [c for c in stored.columns if c != key]
    old = stored.select(key, *(F.col(c).alias(f"old_{c}") for c in columns), F.lit(True).alias("has_old"))
    new = fresh.select(key, *(F.col(c).alias(f"new_{c}") for c in columns), F.lit(True).alias("has_new"))
    both = old.join(new, key, "full_outer")

    def merged(c: str) -> Column:
        if c in updated:
            return F.coalesce(f"new_{c}", f"old_{c}")
        return F.when(F.col("has_old"), F.col(f"old_{c}")).otherwise(F.col(f"new_{c}"))

    event = F.when(F.col("has_old").isNull(), "extract").when(F.col("has_new").isNull(), "kept").otherwise("reextract")
    return both.select(key, *(merged(c).alias(c) for c in columns), event.alias("event"))


def classify_stored(stored: DataFrame, current: DataFrame, source: str, digest: str) -> DataFrame:
    """``stored`` with ``status``: gone without a current source, stale where its digest differs, else kept."""
    now = current.select(F.col(source), F.col(digest).alias("_now"), F.lit(True).alias("_there"))
    status = F.when(F.col("_there").isNull(), "gone").when(F.col("_now").isNotNull() & ~F.col("_now").eqNullSafe(F.col(digest)), "stale").otherwise("kept")
    return stored.join(now, source, "left").withColumn("status", status).drop("_now", "_there")


def conversations(turns: DataFrame, limit: int) -> DataFrame:
    """conv_id, n_turns, last_turn, title: the longest conversations first; the first turn gives the title."""
    first = F.min(F.struct("turn", "role", "text"))
    grouped = turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.max("turn").alias("last_turn"), first.alias("f"))
    return grouped.select("conv_id", "n_turns", "last_turn", truncate(F.col("f.text")).alias("title")).orderBy(F.desc("n_turns"), "conv_id").limit(limit)


def last_turns(turns: DataFrame, k: int) -> DataFrame:
    """The last ``k`` turns of each conversation with their place, 1 the latest; cut before the shuffle ends."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text")
    return turns.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
