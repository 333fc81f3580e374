"""Tables in between, written to the shared folder, so that lineage ends and any executor can be lost."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than 1 / HOT_SHARE of all rows, so at most HOT_SHARE keys can be hot.
HOT_SHARE = 1000


def scratch_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; one is made only where it is unset, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        where = "file://" + tempfile.mkdtemp(prefix="lectern-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table of the shared folder."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_sized(left: DataFrame, right: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row for each key and, in ``size``, the key's rows in ``left``.

    Hot keys are at most HOT_SHARE many and are broadcast, so no task gets a hot key's rows; all others
    are joined by shuffle. ``right`` should be a materialized table, as it is read three times.
    """
    total = right.agg(F.sum(size)).first()[0] or 0
    bound = F.lit(max(1, total // HOT_SHARE))
    hot = F.broadcast(right.filter(F.col(size) > bound))
    cold = right.filter(F.col(size) <= bound)
    return left.join(hot, keys).unionByName(left.join(hot.select(*keys), keys, "left_anti").join(cold, keys))


def spread(table: DataFrame, key: str) -> DataFrame:
    """``table`` by a hash of ``key`` where its scan has fewer partitions than the session has cores, as one small file has; a large one as it is.

    Work on whole texts is worth the shuffle of one file, and no more.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores, key)
