"""Column functions over marked-up pages: pipe tables, spliced table blocks, running heads, captions, boxes.

A box is a struct of x0, y0, x1, y1. Nulls give nulls unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import casefold, collapse, furniture_key

# Shapes of tables, block markers, captions, bounds of regions.
SEPARATOR = r"^\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)+\|?\s*$"
BLOCK_BEGIN, BLOCK_END, BLOCK_HEADING = "<!-- tables:begin -->", "<!-- tables:end -->", "## Extracted tables"
CELL_CHARS = 500
LABEL = r"(?i)^\s*(?:figure|fig)\s*\.?\s*([0-9]+(?:\.[0-9]+)*[a-z]?)"
PAGE_FRACTION, FEWEST_PAGES, REFERENCES_FROM = 0.5, 3, 0.5
CHART_CURVES, PHOTO_SHARE, SCAN_SHARE, SCAN_LINES = 1000, 0.05, 0.85, 20


def clean_cell(value: Column) -> Column:
    """One line, bars escaped; empty for null."""
    return F.trim(F.regexp_replace(F.replace(F.coalesce(value, F.lit("")), F.lit("|"), F.lit(r"\|")), r"\s+", " "))


def padded_rows(rows: Column) -> Column:
    """Clean cells, all rows as wide as the widest."""
    width = F.array_max(F.transform(rows, F.size))
    return F.transform(rows, lambda r: F.concat(F.transform(r, clean_cell), F.array_repeat(F.lit(""), F.greatest(width - F.size(r), F.lit(0)))))


def is_table(rows: Column) -> Column:
    """Two rows and columns at least, two columns with content, no cell of prose."""
    width = F.array_max(F.transform(rows, F.size))
    filled = F.size(F.filter(F.sequence(F.lit(1), F.greatest(width, F.lit(1))), lambda k: F.exists(rows, lambda r: F.coalesce(F.try_element_at(r, k), F.lit("")) != "")))
    return F.coalesce((F.size(rows) >= 2) & (width >= 2) & (filled >= 2) & ~F.exists(rows, lambda r: F.exists(r, lambda c: F.length(c) > CELL_CHARS)), F.lit(False))


def table_markdown(rows: Column) -> Column:
    """A pipe table whose first row is the head."""
    line = F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |")))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(rows[0], lambda c: F.lit("---")), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.slice(line, 1, 1), F.array(rule), F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0)))), "\n")


def strip_tables(markdown: Column) -> Column:
    """Without the block of extracted tables and the blank lines around it."""
    return F.regexp_replace(markdown, f"(?s)\\n*{BLOCK_BEGIN}.*?{BLOCK_END}\\n*", "\n\n")


def has_tables(markdown: Column) -> Column:
    return F.contains(markdown, F.lit(BLOCK_BEGIN))


def splice_tables(markdown: Column, tables: Column) -> Column:
    """The text with one block of all tables at its end, in place of any block before; splicing twice changes nothing."""
    body = F.regexp_replace(strip_tables(markdown), r"\s+$", "")
    block = F.concat(F.lit(f"{BLOCK_BEGIN}\n{BLOCK_HEADING}\n\n"), F.array_join(tables, "\n\n"), F.lit(f"\n{BLOCK_END}\n"))
    return F.when(F.size(tables) > 0, F.concat(body, F.lit("\n\n"), block)).otherwise(F.concat(body, F.lit("\n")))


def pipe_runs(markdown: Column) -> Column:
    """The maximal runs of lines with a bar that hold a rule below a head."""
    runs = F.regexp_extract_all(markdown, F.lit(r"(?m)(?:^[^\n|]*\|[^\n]*(?:\n|\z))+"), 0)
    return F.filter(runs, lambda r: r.rlike(f"(?m){SEPARATOR}"))


def pipe_tables(markdown: Column) -> Column:
    """Runs of three lines at least, of two columns in the head and no cell of prose."""
    def good(run: Column) -> Column:
        lines = F.filter(F.split(run, "\n"), lambda x: F.trim(x) != "")
        head = F.filter(F.split(lines[0], r"\|"), lambda c: F.trim(c) != "")
        return (F.size(lines) >= 3) & (F.size(head) >= 2) & ~F.exists(F.split(run, r"[|\n]"), lambda c: F.length(F.trim(c)) > CELL_CHARS)

    return F.transform(F.filter(pipe_runs(markdown), good), lambda r: F.regexp_replace(r, r"\s+$", ""))


def strip_pipe_tables(markdown: Column) -> Column:
    """The text without pipe tables."""
    return F.aggregate(pipe_runs(markdown), markdown, lambda text, run: F.replace(text, run, F.lit("")))


# Page marks of a text, page delimiters of extracted tables, captions of tables, and the wrapper of a placed block.
PAGE_MARK, PAGE_DELIMITER = r"<!--\s*page:(\d+)\s*-->", r"\n*\{?\d+\}?-{6,}\n*"
TABLE_CAPTION = r"(?im)^[ \t]{0,3}(?:#{1,6}[ \t]*)?(?:\*+[ \t]*)?Table[ \t]+\d+\b"
PLACED = r"(?s)\n*<!--\s*table:marker:page=\d+:begin\s*-->.*?<!--\s*table:marker:page=\d+:end\s*-->\n*"


def paged_tables(markdown: Column, pages: Column) -> Column:
    """page, markdown of each table of a paginated extraction; ``pages`` has the pages of its sections, the last also those of any beyond."""
    sections = F.filter(F.split(markdown, PAGE_DELIMITER), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")) != "")
    page = lambda k: F.element_at(pages, F.least(k + 1, F.size(pages)))
    return F.flatten(F.transform(sections, lambda s, k: F.transform(pipe_tables(s), lambda t: F.struct(page(k).cast("int").alias("page"), t.alias("markdown")))))


def strip_placed(markdown: Column) -> Column:
    return F.concat(F.regexp_replace(F.regexp_replace(markdown, PLACED, "\n\n"), r"\A\s+|\s+\z", ""), F.lit("\n"))


def page_block(tables: Column, page: Column) -> Column:
    """One wrapped block of all tables of a page."""
    own = F.transform(F.filter(tables, lambda t: t["page"] == page), lambda t: t["markdown"])
    mark = F.concat(F.lit("<!-- table:marker:page="), page.cast("string"))
    return F.concat(mark, F.lit(":begin -->\n"), F.array_join(own, "\n\n"), F.lit("\n"), mark, F.lit(":end -->"))


def at_caption(span: Column, block: Column) -> Column:
    """``span`` with the block below the paragraph that begins with a table's caption, or at its end without one.

    A caption and its block stay one paragraph.
    """
    to_gap = rf"(?s)\A(.*?{TABLE_CAPTION}.*?)(?:\n\n(.*))?\z"
    upto, rest = (F.regexp_replace(F.regexp_extract(span, to_gap, k), r"\s+\z" if k == 1 else r"\A\s+|\s+\z", "") for k in (1, 2))
    below = F.concat(upto, F.lit("\n"), block, F.when(rest != "", F.concat(F.lit("\n\n"), rest)).otherwise(""), F.lit("\n"))
    return F.when(span.rlike(TABLE_CAPTION), below).otherwise(F.concat(F.regexp_replace(span, r"\s+\z", ""), F.lit("\n\n"), block, F.lit("\n")))


def held(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is taken once, however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def place_tables(markdown: Column, tables: Column) -> Column:
    """The text with the ``tables`` (page, markdown) of each page at their caption, in place of the page's own pipe tables.

    A page is what stands from its first mark to the next mark of any page. Pages without tables stay as
    they are; tables of pages without mark come at the end, the last page first. Placing twice is placing once.
    """

    def of_pieces(pieces: Column, tables: Column) -> Column:
        marks = F.transform(pieces, lambda p: F.nullif(F.regexp_extract(p, rf"\A{PAGE_MARK}", 1), F.lit("")).cast("int"))
        pages = F.array_distinct(F.transform(tables, lambda t: t["page"]))
        return held(marks, lambda marks: held(pages, lambda pages: body(pieces, marks, pages, tables)))

    def body(pieces: Column, marks: Column, pages: Column, tables: Column) -> Column:
        def placed(piece: Column, k: Column) -> Column:
            page = F.element_at(marks, k + 1)
            first = F.array_position(marks, page) == k + 1
            mark = F.regexp_extract(piece, rf"\A{PAGE_MARK}", 0)
            span = strip_pipe_tables(F.regexp_replace(piece, rf"\A{PAGE_MARK}", ""))
            own = held(span, lambda span: held(page_block(tables, page), lambda block: F.concat(mark, at_caption(span, block))))
            return F.when(F.coalesce(first & F.array_contains(pages, page), F.lit(False)), own).otherwise(piece)

        missing = F.reverse(F.array_sort(F.array_except(pages, F.array_compact(marks))))
        whole = F.array_join(F.transform(pieces, placed), "")
        return F.aggregate(missing, whole, lambda text, page: F.concat(F.regexp_replace(text, r"\s+\z", ""), F.lit("\n\n"), page_block(tables, page), F.lit("\n")))

    return held(F.split(strip_placed(markdown), f"(?={PAGE_MARK})"), lambda pieces: held(tables, lambda tables: of_pieces(pieces, tables)))


def running_heads(pages: Column) -> Column:
    """Keys of lines that stand on half of the pages, three at least; none for fewer than three pages."""
    keys = F.flatten(F.transform(pages, lambda p: F.array_distinct(F.filter(F.transform(F.split(p, "\n"), furniture_key), lambda k: k != ""))))
    most = F.greatest(F.lit(FEWEST_PAGES), F.ceil(PAGE_FRACTION * F.size(pages)).cast("int"))
    often = F.filter(F.array_distinct(keys), lambda k: F.size(F.filter(keys, lambda x: x == k)) >= most)
    return F.when(F.size(pages) >= FEWEST_PAGES, often).otherwise(F.array().cast("array<string>"))


def strip_running_heads(pages: Column, heads: Column) -> Column:
    """The pages without the lines of these keys."""
    return F.transform(pages, lambda p: F.array_join(F.filter(F.split(p, "\n"), lambda x: ~F.array_contains(heads, furniture_key(x))), "\n"))


def strip_references(text: Column) -> Column:
    """The text up to a heading of references that begins in its second half."""
    heading = r"(?im)^(?:#{1,6}\s*)?\*{0,2}(?:references|bibliography)\*{0,2}\s*$"
    at = F.regexp_instr(text, F.lit(heading))
    return F.when((at > 0) & (at - 1 >= REFERENCES_FROM * F.length(text)), F.substring(text, F.lit(1), at - 1)).otherwise(text)


def figure_label(caption: Column) -> Column:
    """The number of a figure's caption, like 2.1b."""
    return F.nullif(F.lower(F.regexp_extract(caption, LABEL, 1)), F.lit(""))


def mentions_figure(text: Column, label: Column) -> Column:
    """Whether prose refers to a figure by its number, alone or in a list."""
    return F.rlike(text, F.concat(F.lit(r"(?i)\bfig(?:ure)?s?\.?\s*(?:[0-9.]+[a-z]?\s*(?:,|and|&|-)\s*)*\Q"), label, F.lit(r"\E(?![0-9a-z.]*[0-9a-z])")))


def area(box: Column) -> Column:
    return F.abs((box["x1"] - box["x0"]) * (box["y1"] - box["y0"]))


def union_box(boxes: Column) -> Column:
    """The smallest box around all boxes; null for none."""

    def over(f, name: str) -> Column:  # noqa: ANN001
        return f(F.transform(boxes, lambda b: b[name])).alias(name)

    return F.when(F.size(boxes) > 0, F.struct(over(F.array_min, "x0"), over(F.array_min, "y0"), over(F.array_max, "x1"), over(F.array_max, "y1")))


def clip(box: Column, page: Column) -> Column:
    """What of a box lies on the page; null where nothing does."""
    cut = [F.greatest(box[c], page[c]).alias(c) for c in ("x0", "y0")] + [F.least(box[c], page[c]).alias(c) for c in ("x1", "y1")]
    return F.when((cut[0] < cut[2]) & (cut[1] < cut[3]), F.struct(*cut))


def vertical_gap(a: Column, b: Column) -> Column:
    """The distance between two boxes one above the other; 0 where they overlap in height."""
    return F.greatest(a["y0"] - b["y1"], b["y0"] - a["y1"], F.lit(0.0))


def nearest_caption(box: Column, captions: Column) -> Column:
    """The caption (text, box) with the least vertical gap, the first of equals."""
    scored = F.transform(captions, lambda c, k: F.struct(vertical_gap(box, c["box"]).alias("gap"), k.alias("k"), c["text"].alias("text")))
    return F.array_min(scored)["text"]


def is_renderable(box: Column) -> Column:
    return (box["x1"] - box["x0"] >= 1) & (box["y1"] - box["y0"] >= 1)


def is_page_scan(box: Column, page: Column, caption: Column, lines: Column) -> Column:
    """A region that fills the page, unless it has a caption and little text stands beside it."""
    return (area(box) >= SCAN_SHARE * area(page)) & ~(caption.isNotNull() & (lines <= SCAN_LINES))


def page_kind(table_caption: Column, curves: Column, raster_share: Column, figure_caption: Column) -> Column:
    """table, chart, photo, figure or text, the first that holds."""
    return F.when(table_caption, "table").when(curves >= CHART_CURVES, "chart").when(raster_share >= PHOTO_SHARE, "photo").when(figure_caption, "figure").otherwise("text")


def describe_reason(caption: Column, image: Column, fewest: int = 20) -> Column:
    """Why a figure is not described; null where it is."""
    return F.when(F.coalesce(image, F.lit("")) == "", "no image").when(F.length(collapse(F.coalesce(caption, F.lit("")))) < fewest, "caption too short")


def title_key(text: Column) -> Column:
    return casefold(collapse(text))
