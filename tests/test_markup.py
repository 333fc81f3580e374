"""Placing tables takes each value once."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import markup as M


def test_values_are_taken_once(spark):
    rows = spark.createDataFrame([("a",)], "text string").select(M.place_tables(F.col("text"), F.expr("array(named_struct('page', 1, 'markdown', 'x'))")).alias("p"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_tables_at_captions_at_ends_and_of_missing_pages(spark):
    text = "<!-- page:1 -->\nT\n\n**Table 1.** C\n\nend\n<!-- page:2 -->\nProse\n| a | b |\n|---|---|\n| 1 | 2 |\n"
    tables = F.expr("array(named_struct('page', 1, 'markdown', 'one'), named_struct('page', 2, 'markdown', 'two'), named_struct('page', 7, 'markdown', 'seven'))")
    once = M.place_tables(F.col("text"), tables)
    row = spark.createDataFrame([(text,), (None,)], "text string").select(once.alias("p"), M.place_tables(once, tables).alias("q")).collect()
    assert row[0].p == row[0].q and row[1].p is None
    places = [row[0].p.index(x) for x in ("**Table 1.** C", "one", "end", "Prose", "two", "seven")]
    assert places == sorted(places) and "| a | b |" not in row[0].p
