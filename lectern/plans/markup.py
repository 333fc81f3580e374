"""Queries: tables, running heads, captions and boxes of marked-up pages that are derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import markup as M
from lectern.operators.scratch import spread
from lectern.plans.registry import query, table

CELLS = "[[p_brand, replace(p_name, 'a', '|'), CASE WHEN p_size > 25 THEN p_type END], [CAST(p_size AS VARCHAR), '  x  y ']]"
CLEAN = "trim(regexp_replace(replace(coalesce({0}, ''), '|', '\\|'), '\\s+', ' ', 'g'))"


@query(f"""WITH c AS (SELECT p_partkey, {CELLS} AS r FROM part), k AS (SELECT p_partkey, list_transform(r, lambda x: list_transform(list_resize(x, 3, ''), lambda c: {CLEAN.format("c")})) AS r FROM c)
SELECT p_partkey, '| ' || array_to_string(r[1], ' | ') || ' |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| ' || array_to_string(r[2], ' | ') || ' |' AS markdown, TRUE AS meaningful FROM k""")
def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.array("p_brand", F.replace("p_name", F.lit("a"), F.lit("|")), F.when(F.col("p_size") > 25, F.col("p_type")))
    rows = table(spark, sf_dir, "part").select("p_partkey", M.padded_rows(F.array(first, F.array(F.col("p_size").cast("string"), F.lit("  x  y ")))).alias("r"))
    return rows.select("p_partkey", M.table_markdown(F.col("r")).alias("markdown"), M.is_table(F.col("r")).alias("meaningful"))


# A text with a pipe table, a block of tables from an earlier run, or neither.
TEXT = "'Title ' || p_name || chr(10) || chr(10) || CASE p_partkey % 3 WHEN 0 THEN '| a | b |' || chr(10) || '|---|:-:|' || chr(10) || '| ' || p_size || ' | x |' || chr(10) || 'after' WHEN 1 THEN 'one | bar' || chr(10) || chr(10) || '<!-- tables:begin -->' || chr(10) || 'old' || chr(10) || '<!-- tables:end -->' || chr(10) ELSE 'plain  ' || chr(10) END"


@query(f"""WITH t AS (SELECT p_partkey, p_size, p_name, {TEXT} AS md FROM part), b AS (SELECT *, CASE p_partkey % 3 WHEN 0 THEN md WHEN 1 THEN 'Title ' || p_name || chr(10) || chr(10) || 'one | bar' ELSE 'Title ' || p_name || chr(10) || chr(10) || 'plain' END AS body FROM t)
SELECT p_partkey, p_partkey % 3 = 1 AS spliced, body || chr(10) || chr(10) || '<!-- tables:begin -->' || chr(10) || '## Extracted tables' || chr(10) || chr(10) || 'T' || p_size || chr(10) || '<!-- tables:end -->' || chr(10) AS again,
  CASE WHEN p_partkey % 3 = 0 THEN '| a | b |' || chr(10) || '|---|:-:|' || chr(10) || '| ' || p_size || ' | x |' ELSE '' END AS tables, CASE WHEN p_partkey % 3 = 0 THEN 'Title ' || p_name || chr(10) || chr(10) || 'after' ELSE md END AS plain FROM b""")
def spliced_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splicing twice is splicing once; pipe tables are found and left out."""
    md, one = F.col("md"), F.array(F.concat(F.lit("T"), "p_size"))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.expr(TEXT).alias("md"))
    again = M.splice_tables(M.splice_tables(md, one), one)
    return rows.select("p_partkey", M.has_tables(md).alias("spliced"), again.alias("again"), F.array_join(M.pipe_tables(md), "\n\n").alias("tables"), M.strip_pipe_tables(md).alias("plain"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'Head # | one ' || o_orderkey || ' ~ Head # | two ~ ' || CASE WHEN o_custkey % 2 = 0 THEN 'Head 7' ELSE 'x' END ELSE CASE WHEN o_custkey % 2 = 0 THEN 'one ' || o_orderkey || ' ~ two ~ ' ELSE 'Head 1 | one ' || o_orderkey || ' ~ HEAD 2 | two ~ x' END END AS pages FROM orders WHERE o_custkey % 3 <> 0
UNION ALL SELECT o_orderkey, 'Head 1 | one ' || o_orderkey || ' ~ HEAD 2 | two' FROM orders WHERE o_custkey % 3 = 0""")
def running_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A head on three of three pages goes, on two of three or two of two it stays."""
    odd = F.col("o_custkey") % 3
    pages = F.array(F.concat(F.lit("Head 1\none "), "o_orderkey"), F.lit("HEAD 2\ntwo"))
    third = F.when(F.col("o_custkey") % 2 == 0, "Head 7").otherwise("x")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(odd == 0, pages).otherwise(F.concat(pages, F.array(third))).alias("p"))
    kept = M.strip_running_heads(F.col("p"), M.running_heads(F.col("p")))
    return rows.select("o_orderkey", F.array_join(F.transform(kept, lambda p: F.replace(p, F.lit("\n"), F.lit(" | "))), " ~ ").alias("pages"))


@query("""WITH t AS (SELECT doc_id, substr(coalesce(text, ''), 1, 100 + doc_id % 50) AS h FROM documents) SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND length(h) + 1 >= 0.5 * (length(h) + 28) THEN h || chr(10) ELSE h || chr(10) || CASE doc_id % 3 WHEN 0 THEN '## References' ELSE 'references of' END || chr(10) || '- one of them' END AS kept FROM t""")
def strip_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.expr("substr(coalesce(text, ''), 1, 100 + cast(doc_id % 50 AS INT))")
    text = F.concat(head, F.lit("\n"), F.when(F.col("doc_id") % 3 == 0, "## References").otherwise("references of"), F.lit("\n- one of them"))
    return table(spark, sf_dir, "documents").select("doc_id", M.strip_references(text).alias("kept"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_partkey % 4 WHEN 0 THEN 'Figure ' || l_linenumber || ': words' WHEN 1 THEN ' FIG. 2.' || l_linenumber || 'B text' WHEN 2 THEN 'Table 1' END AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_partkey % 4 WHEN 0 THEN CAST(l_linenumber AS VARCHAR) WHEN 1 THEN '2.' || l_linenumber || 'b' END AS label, CASE WHEN l_suppkey % 5 = 0 THEN 'no image' WHEN length(trim(coalesce(c, ''))) < 16 THEN 'caption too short' END AS reason, l_linenumber IN (1, 3, 4) AS mentioned FROM c""")
def figure_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, line = F.col("l_partkey") % 4, F.col("l_linenumber")
    caption = F.when(part == 0, F.concat(F.lit("Figure "), line, F.lit(": words"))).when(part == 1, F.concat(F.lit(" FIG. 2."), line, F.lit("B text"))).when(part == 2, "Table 1")
    image = F.when(F.col("l_suppkey") % 5 == 0, "").otherwise("f.png")
    seen = M.mentions_figure(F.lit("As figs. 1, 3 and 4 show, not 25 or Figure 27."), line.cast("string"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", M.figure_label(caption).alias("label"), M.describe_reason(caption, image, 16).alias("reason"), seen.alias("mentioned"))


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(*(v.cast("double").alias(n) for v, n in zip((x0, y0, x1, y1), ("x0", "y0", "x1", "y1"), strict=True)))


BOXES = "b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey % 90)::DOUBLE AS x0, (l_suppkey % 7 * 20)::DOUBLE AS y0, (l_partkey % 90 + l_linenumber * 30)::DOUBLE AS x1, (l_suppkey % 7 * 20 + l_quantity)::DOUBLE AS y1 FROM lineitem)"


@query(f"""WITH {BOXES} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, x1 - x0 >= 1 AND y1 - y0 >= 1 AS renderable, CASE WHEN x0 < 100 AND y0 < 100 THEN (least(x1, 100) - x0) * (least(y1, 100) - y0) END AS inside, greatest(y0 - 60, 50 - y1, 0) AS gap,
  least(x0, 5) || ',' || greatest(y1, 60) AS around, CASE WHEN greatest(y0 - 60, 50 - y1, 0) <= greatest(y0 - 160, 150 - y1, 0) THEN 'near' ELSE 'far' END AS caption,
  (x1 - x0) * (y1 - y0) >= 0.85 * 10000 AND NOT (l_partkey % 2 = 0 AND l_linenumber <= 20) AS scan, CASE WHEN l_partkey % 7 = 0 THEN 'table' WHEN l_suppkey * 300 >= 1000 THEN 'chart' WHEN l_linenumber / 50 >= 0.05 THEN 'photo' WHEN l_partkey % 2 = 0 THEN 'figure' ELSE 'text' END AS kind FROM b""")
def page_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, supp, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    left, top = part % 90, supp % 7 * 20
    number = [F.lit(v) for v in (5, 50, 60, 150, 160, 100, 0)]
    own, page = box(left, top, left + line * 30, top + F.col("l_quantity")), box(number[6], number[6], number[5], number[5])
    near, far = box(number[0], number[1], number[0], number[2]), box(number[0], number[3], number[0], number[4])
    around = M.union_box(F.array(own, near))
    captions = F.array(F.struct(F.lit("near").alias("text"), near.alias("box")), F.struct(F.lit("far").alias("text"), far.alias("box")))
    return table(spark, sf_dir, "lineitem").select(
        *("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
        M.is_renderable(own).alias("renderable"),
        M.area(M.clip(own, page)).alias("inside"),
        M.vertical_gap(own, near).alias("gap"),
        F.concat_ws(",", around["x0"].cast("string"), around["y1"].cast("string")).alias("around"),
        M.nearest_caption(own, captions).alias("caption"),
        M.is_page_scan(own, page, F.when(part % 2 == 0, "c"), line).alias("scan"),
        M.page_kind(part % 7 == 0, supp * 300, line / 50, part % 2 == 0).alias("kind"),
    )


# Two pages, the first with a caption, the second with a lossy twin of its table; and an extraction of two sections.
PAGES = "'Intro' || chr(10) || '<!-- page:1 -->' || chr(10) || 'Text one.' || chr(10) || chr(10) || CASE WHEN p_partkey % 2 = 0 THEN '**Table 1.** All of ' || p_brand ELSE 'No table of ' || p_brand END || chr(10) || chr(10) || 'after it' || chr(10) || '<!-- page:2 -->' || chr(10) || 'Prose' || chr(10) || '| old | twin |' || chr(10) || '|---|---|' || chr(10) || '| 1 | 2 |' || chr(10)"
EXTRACTED = "'| a | b |' || chr(10) || '|---|---|' || chr(10) || '| ' || p_size || ' | x |' || chr(10) || chr(10) || '{1}----------' || chr(10) || chr(10) || 'said' || chr(10) || chr(10) || '| c | d |' || chr(10) || '|---|---|' || chr(10) || '| ' || p_partkey || ' | y |' || chr(10)"


def block_sql(page: str, head: str, cell: str) -> str:
    return f"'<!-- table:marker:page={page}:begin -->' || chr(10) || '| {head} |' || chr(10) || '|---|---|' || chr(10) || '| ' || {cell} || ' |' || chr(10) || '<!-- table:marker:page={page}:end -->'"


@query(f"""WITH p AS (SELECT p_partkey, {block_sql("1", "a | b", "p_size || ' | x'")} AS one, {block_sql("2", "c | d", "p_partkey || ' | y'")} AS two, {block_sql("7", "c | d", "p_partkey || ' | y'")} AS seven, p_brand FROM part
), f AS (SELECT *, 'Intro' || chr(10) || '<!-- page:1 -->' || chr(10) || 'Text one.' || chr(10) || chr(10) || CASE WHEN p_partkey % 2 = 0 THEN '**Table 1.** All of ' || p_brand || chr(10) || one || chr(10) || chr(10) || 'after it' ELSE 'No table of ' || p_brand || chr(10) || chr(10) || 'after it' || chr(10) || chr(10) || one END || chr(10) || '<!-- page:2 -->' || chr(10) || 'Prose' AS head FROM p)
SELECT p_partkey, head || CASE WHEN p_partkey % 3 = 0 THEN chr(10) || '| old | twin |' || chr(10) || '|---|---|' || chr(10) || '| 1 | 2 |' || chr(10) || chr(10) || seven ELSE chr(10) || chr(10) || two END || chr(10) AS placed, TRUE AS again FROM f""")
def placed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables go to their pages' captions, to the end of a page without one, or to the end of the text; placing twice is placing once."""
    pages = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit(1), F.lit(7))).otherwise(F.array(F.lit(1), F.lit(2)))

    def twice(t: Column) -> Column:
        return M.held(M.place_tables(F.expr(PAGES), t), lambda placed: F.struct(placed.alias("placed"), (M.place_tables(placed, t) == placed).alias("again")))

    rows = spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", M.held(M.paged_tables(F.expr(EXTRACTED), pages), twice).alias("x"))
    return rows.select("p_partkey", "x.placed", "x.again")
