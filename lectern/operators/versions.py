"""Tables that keep their rows while their columns change: versions over Parquet.

A table is a folder. A version says which parts of rows it consists of, which columns it has, and what
value a column has in parts that were written before it: so an added column costs no rewriting, and a
reader of an earlier version sees neither it nor later rows. A rebuild writes the rows that stay, in the
new shape, as one part. A version is one small file that is written last; what breaks off before that
has changed nothing. One writer at a time is assumed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

VERSION = "version long, columns string, parts string"


def log(spark: SparkSession, where: str) -> DataFrame:
    try:
        return spark.read.schema(VERSION).parquet(f"{where}/versions")
    except AnalysisException:
        return spark.createDataFrame([], VERSION)


def state(spark: SparkSession, where: str, version: int | None = None) -> dict | None:
    """version, columns (name, type, default as an SQL literal) and parts of a version, the newest if None; None where there is none."""
    rows = log(spark, where)
    rows = rows if version is None else rows.filter(F.col("version") == version)
    row = rows.orderBy(F.desc("version")).first()
    return row and {"version": row["version"], "columns": json.loads(row["columns"]), "parts": json.loads(row["parts"])}


def commit(spark: SparkSession, where: str, columns: list, parts: list) -> int:
    version = (log(spark, where).agg(F.max("version")).first()[0] or 0) + 1
    spark.createDataFrame([(version, json.dumps(columns), json.dumps(parts))], VERSION).coalesce(1).write.mode("append").parquet(f"{where}/versions")
    return version


def write_part(rows: DataFrame, where: str) -> dict:
    name = uuid.uuid4().hex
    rows.write.parquet(f"{where}/parts/{name}")
    return {"part": name, "has": rows.columns}


def typed(rows: DataFrame, columns: list) -> DataFrame:
    """``rows`` in the shape of ``columns``: what they lack has its default, what is unknown goes."""
    return rows.select(*(F.col(n).cast(t) if n in rows.columns else F.expr(d or "NULL").cast(t).alias(n) for n, t, d in columns))


def create(rows: DataFrame, where: str) -> int:
    """The first version, with the rows and columns of ``rows``; an existing table stays and its version is given."""
    known = state(rows.sparkSession, where)
    if known:
        return known["version"]
    return commit(rows.sparkSession, where, [[f.name, f.dataType.simpleString(), None] for f in rows.schema], [write_part(rows, where)])


def append(rows: DataFrame, where: str) -> int:
    now = state(rows.sparkSession, where)
    return commit(rows.sparkSession, where, now["columns"], [*now["parts"], write_part(typed(rows, now["columns"]), where)])


def add_columns(spark: SparkSession, where: str, wanted: list[tuple[str, str, str | None]]) -> list[str]:
    """Add the columns (name, type, default as an SQL literal) that are missing, without touching rows; the names of those added."""
    now = state(spark, where)
    known = {n for n, _, _ in now["columns"]}
    new = [list(c) for c in wanted if c[0] not in known]
    if new:
        commit(spark, where, now["columns"] + new, now["parts"])
    return [n for n, _, _ in new]


def rebuild(spark: SparkSession, where: str, shape: StructType, keep: Column | None = None, references: tuple[str, DataFrame] | None = None) -> int:
    """Write the rows anew in ``shape``: columns of both shapes are carried over, new ones are null.

    ``keep`` is a condition on rows; ``references``, a column and a table with a column of that name, drops
    rows that point to nothing there. Gives the number of rows dropped.
    """
    old = read(spark, where)
    kept = old if keep is None else old.filter(keep)
    if references is not None:
        name, target = references
        kept = kept.join(target.select(name).distinct(), name, "left_semi")
    columns = [[f.name, f.dataType.simpleString(), None] for f in shape]
    part = write_part(typed(kept, columns), where)
    commit(spark, where, columns, [part])
    return old.count() - read(spark, where).count()


def read(spark: SparkSession, where: str, version: int | None = None) -> DataFrame:
    """The rows of a version in its shape."""
    now = state(spark, where, version)
    if now is None:
        raise ValueError(f"no version {version or ''} of a table at {where}")
    out = None
    for part in now["parts"]:
        rows = typed(spark.read.parquet(f"{where}/parts/{part['part']}").select(*part["has"]), now["columns"])
        out = rows if out is None else out.unionByName(rows)
    return out
