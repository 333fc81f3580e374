"""A taxonomy of fields: a hierarchy without cycles, and the documents placed in it.

Edges are (child, parent, origin), links (doc, field, origin). Repeated rows count once, nulls join with
nothing, and empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import casefold
from lectern.operators import graph
from lectern.operators.scratch import materialize


def add_edges(edges: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges after adding ``fresh``, rejected ones with why).

    An edge is a cycle where its parent is the child itself or one of its descendants; of new edges
    that close a cycle only together, all are rejected. An edge that is there already is promoted
    from proposed to curated, never back.
    """
    both = edges.select("child", "parent", "origin", F.lit(0).alias("new")).unionByName(fresh.select("child", "parent", "origin", F.lit(1).alias("new")))
    merged = materialize(both.groupBy("child", "parent").agg(F.min(F.when(F.col("origin") == "curated", 0).otherwise(1)).alias("o"), F.min("new").alias("new")), "hierarchy")
    up = graph.ancestors(merged.filter("child <> parent"))
    loops = up.select(F.col("node").alias("parent"), F.col("ancestor").alias("child"))
    closes = merged.filter("new = 1").join(loops, ["parent", "child"], "left_semi").select("child", "parent")
    bad = closes.unionByName(merged.filter("new = 1 AND child = parent").select("child", "parent")).distinct()
    bad = materialize(bad, "cycles")
    origin = F.when(F.col("o") == 0, "curated").otherwise("proposed")
    kept = merged.join(bad, ["child", "parent"], "left_anti").select("child", "parent", origin.alias("origin"))
    return kept, bad.withColumn("why", F.lit("cycle"))


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select("child", "parent").distinct(), ["child", "parent"], "left_anti")


def attach(links: DataFrame, fresh: DataFrame, fields: DataFrame) -> DataFrame:
    """Links with the new ones whose field is among ``fields`` (field); a curated link is never made a proposed one."""
    fine = fresh.join(fields.select("field").distinct(), "field", "left_semi")
    both = links.select("doc", "field", "origin").unionByName(fine.select("doc", "field", "origin"))
    return both.groupBy("doc", "field").agg(F.min("origin").alias("origin"))


def detach(links: DataFrame, gone: DataFrame) -> DataFrame:
    return links.join(gone.select("doc", "field").distinct(), ["doc", "field"], "left_anti")


def field_view(fields: DataFrame, edges: DataFrame, links: DataFrame) -> DataFrame:
    """field, n_parents, n_children, n_direct, n_proposed, n_rolled_up, is_root.

    Rolled-up documents are counted once for each field above them, however many paths there are.
    """
    parents = edges.groupBy(F.col("child").alias("field")).agg(F.count_distinct("parent").alias("n_parents"))
    children = edges.groupBy(F.col("parent").alias("field")).agg(F.count_distinct("child").alias("n_children"))
    direct = links.groupBy("field").agg(F.count_distinct("doc").alias("n_direct"), F.count_distinct(F.when(F.col("origin") == "proposed", F.col("doc"))).alias("n_proposed"))
    own = links.select("doc", "field").distinct()
    above = own.join(graph.ancestors(edges).withColumnRenamed("node", "field"), "field").select("doc", F.col("ancestor").alias("field"))
    rolled = own.unionByName(above).distinct().groupBy("field").agg(F.count("*").alias("n_rolled_up"))
    out = fields.select("field").distinct()
    for part in (parents, children, direct, rolled):
        out = out.join(part, "field", "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_parents", "n_children", "n_direct", "n_proposed", "n_rolled_up")]
    return out.select("field", *counts, F.col("n_parents").isNull().alias("is_root"))


def narrower(edges: DataFrame, field: str) -> DataFrame:
    """field: the direct children of one field."""
    return edges.filter(F.col("parent") == field).select(F.col("child").alias("field")).distinct()


def unplaced(items: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """Items that no link places."""
    return items.join(links.select(key).distinct(), key, "left_anti")


def proposals(links: DataFrame, suggested: DataFrame, fields: DataFrame) -> DataFrame:
    """doc, field, outcome of suggested placements: written, known, or rejected where there is no such field."""
    known = links.select("doc", "field", F.lit(True).alias("known")).distinct()
    there = fields.select("field", F.lit(True).alias("there")).distinct()
    both = suggested.select("doc", "field").distinct().join(known, ["doc", "field"], "left").join(there, "field", "left")
    return both.select("doc", "field", F.when(F.col("there").isNull(), "rejected").when(F.col("known"), "known").otherwise("written").alias("outcome"))


def candidates(fields: DataFrame) -> DataFrame:
    """field, sort_key: the key by which labels are listed, whatever their case."""
    return fields.select("field", casefold(F.col("field")).alias("sort_key"))
