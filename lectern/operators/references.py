"""Reference lists of documents, resolved to the library, and their export.

A document without a heading of references has no rows; null texts have none. Empty tables give empty
results; repeated rows are read each; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import references as R
from lectern.functions.text import escape_bibtex
from lectern.operators import fuzzy
from lectern.operators.scratch import join_sized, materialize


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, place, raw, doi, year, authors, title, confidence of every reference."""
    blocks = docs.select(F.col(id_col).alias("doc"), R.reference_block(F.col(text_col)).alias("block")).filter("block IS NOT NULL")
    entries = blocks.select("doc", F.posexplode(R.split_references(F.col("block"))).alias("place", "entry"))
    return R.parsed(entries)


def extraction_notes(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", few: int = 5) -> DataFrame:
    """doc, has_section, n, needs_more: a section with fewer than ``few`` references needs a closer look."""
    n = found.groupBy("doc").agg(F.count("*").alias("n"))
    out = docs.select(F.col(id_col).alias("doc"), R.reference_block(F.col(text_col)).isNotNull().alias("has_section")).join(n, "doc", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("doc", F.coalesce("has_section", F.lit(False)).alias("has_section"), "n", (F.coalesce("has_section", F.lit(False)) & (F.col("n") < few)).alias("needs_more"))


def resolve(references: DataFrame, library: DataFrame, ratio: float | None = None) -> DataFrame:
    """doc, place, target, how: the document that a reference names, by doi, then first surname and year, then title.

    ``library`` has doc_id, doi, authors, year, title and only documents that may be named. Each rule
    looks only at the references that are still open and have its key, so null keys meet nowhere; a key
    leads to one document, the smallest identifier, and hot keys are joined by broadcast. Titles have
    to be equal when normalised; with ``ratio``, the most alike title from that ratio on is taken.
    """
    named = library.withColumn("surname", R.first_surname(F.col("authors")))
    title = F.when(F.length("title") >= 10, F.nullif(R.normalize_name(F.col("title")), F.lit("")))
    rules = {"doi": [F.lower(F.trim("doi"))], "author_year": [F.col("surname"), F.col("year")], "title": [title]}
    left = materialize(references.select("doc", "place", "doi", "year", "title", R.first_surname(F.col("authors")).alias("surname")), "open")
    found = None
    for how, columns in rules.items():
        on = [f"key{k}" for k in range(len(columns))]
        keyed, known = (t.select(*others, *(c.alias(k) for c, k in zip(columns, on, strict=True))).na.drop(subset=on) for t, others in ((left, ["doc", "place"]), (named, ["doc_id"])))
        keys = keyed.groupBy(*on).agg(F.count("*").alias("_n"))
        to = keys.join(known.groupBy(*on).agg(F.min("doc_id").alias("target")), on)
        if how == "title" and ratio is not None:
            whole = library.select("doc_id", R.normalize_name(F.col("title")).alias("title"))
            best = fuzzy.best_match(keys.select(F.col("key0").alias("title")), whole, ratio)
            to = keys.join(best.select(F.col("title").alias("key0"), "target"), "key0")
        hits = materialize(join_sized(keyed, materialize(to, "targets"), on, "_n").select("doc", "place", "target", F.lit(how).alias("how")), "resolved")
        found = hits if found is None else found.unionByName(hits)
        left = left.join(hits.select("doc", "place"), ["doc", "place"], "left_anti")
        if how != "title":
            left = materialize(left, "open")
    return found.unionByName(left.select("doc", "place"), allowMissingColumns=True)


def credible(references: DataFrame, resolved: DataFrame, library: DataFrame) -> DataFrame:
    """doc, place, target, credible of resolved references: whether title or doi agree with the document."""
    named = library.select(F.col("doc_id").alias("target"), F.col("title").alias("l_title"), F.col("doi").alias("l_doi"))
    both = resolved.filter("target IS NOT NULL").join(references.select("doc", "place", "title", "doi"), ["doc", "place"]).join(named, "target")
    return both.select("doc", "place", "target", R.same_paper(F.col("title"), F.col("doi"), F.col("l_title"), F.col("l_doi")).alias("credible"))


def cites_out(references: DataFrame, resolved: DataFrame, library: DataFrame) -> DataFrame:
    """doc, place, raw, year, target, filename: what each document cites, the library's file where it is there."""
    to = resolved.select("doc", "place", "target").join(library.select(F.col("doc_id").alias("target"), "filename"), "target", "left")
    return references.select("doc", "place", "raw", "year").join(to, ["doc", "place"], "left")


def cited_by(resolved: DataFrame, library: DataFrame) -> DataFrame:
    """target, doc, filename: the documents that cite a document, each once."""
    own = resolved.filter("target IS NOT NULL AND target <> doc").select("target", "doc").distinct()
    return own.join(library.select(F.col("doc_id").alias("doc"), "filename"), "doc").select("target", "doc", "filename")


def reference_views(out: DataFrame, cap: int) -> DataFrame:
    """doc, rank, place, total: the first ``cap`` references of each document, latest first, with the number of all."""
    order = Window.partitionBy("doc").orderBy(F.desc_nulls_last("year"), "place")
    total = F.count("*").over(Window.partitionBy("doc"))
    return out.withColumn("rank", F.row_number().over(order)).withColumn("total", total).filter(F.col("rank") <= cap).select("doc", "rank", "place", "total")


def bibtex(docs: DataFrame) -> DataFrame:
    """doc_id, key, kind, entry of every document; equal keys get a, b, ... in order of the identifier, _26 and on beyond z."""
    key = R.citation_key(F.col("doc_id"), F.col("format"), F.col("filename"), F.col("authors"), F.col("year"))
    keyed = docs.withColumn("base", key)
    order, same = Window.partitionBy("base").orderBy("doc_id"), Window.partitionBy("base")
    keyed = keyed.withColumn("place", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(same))
    suffix = F.when(F.col("n") == 1, "").when(F.col("place") < 26, F.char(97 + F.col("place"))).otherwise(F.concat(F.lit("_"), F.col("place").cast("string")))
    paper = F.col("format").isin("pdf", "epub", "html", "htm") & F.col("authors").isNotNull() & F.col("year").isNotNull()
    kind = F.when(paper, "article").otherwise("misc")
    fields = [("author", "authors"), ("title", "title"), ("year", "year")]
    lines = [F.when(F.trim(F.col(c).cast("string")) != "", F.concat(F.lit(f"  {f} = {{"), escape_bibtex(F.col(c).cast("string")), F.lit("}"))) for f, c in fields]
    keyed = keyed.withColumn("key", F.concat("base", suffix)).withColumn("kind", kind)
    return keyed.select("doc_id", "key", "kind", F.concat(F.lit("@"), "kind", F.lit("{"), "key", F.lit(",\n"), F.concat_ws(",\n", *lines), F.lit("\n}")).alias("entry"))
