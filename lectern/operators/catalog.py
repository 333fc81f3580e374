"""Reads and edits of a document library: filters, groups, facets, families, folders, overrides.

Documents are rows with doc_id, filename, format, health, title, authors, year, archived, added;
keywords are long (doc_id, name), folder links (doc_id, folder). Null columns sort last and match no
filter; empty tables give empty results (counts give one row with 0). Other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import author_label, casefold, date_bucket

# Orders of display.
DATE_BUCKETS = ("today", "week", "month", "earlier")
SORTS = {
    "title": (F.asc, "label"),
    "author": (F.asc_nulls_last, "author"),
    "year": (F.desc_nulls_last, "year"),
    "added": (F.desc_nulls_last, "added"),
}


def live(docs: DataFrame) -> DataFrame:
    return docs.filter(~F.coalesce("archived", F.lit(False)))


def override(value: str, auto: str) -> Column:
    """The override unless it is null or empty, else what was found automatically."""
    return F.coalesce(F.nullif(F.col(value), F.lit("")), F.col(auto))


def stored_override(value: str, auto: str) -> Column:
    """What an override is stored as: null where it is blank or says nothing new."""
    trimmed = F.trim(value)
    return F.when((trimmed != "") & ~trimmed.eqNullSafe(F.col(auto)), trimmed)


def list_documents(docs: DataFrame, overrides: DataFrame, health: str | None = None, fmt: str | None = None, folder: DataFrame | None = None) -> DataFrame:
    """doc_id, filename, title, authors, year of documents that are not archived and pass every filter given.

    ``overrides`` has doc_id and o_title, o_authors, o_year; ``folder`` the doc_ids of one folder.
    """
    kept = live(docs)
    for column, wanted in (("health", health), ("format", fmt)):
        if wanted is not None:
            kept = kept.filter(F.col(column) == wanted)
    if folder is not None:
        kept = kept.join(folder.select("doc_id").distinct(), "doc_id", "left_semi")
    both = kept.join(overrides, "doc_id", "left")
    return both.select("doc_id", "filename", override("o_title", "title").alias("title"), override("o_authors", "authors").alias("authors"), F.coalesce("o_year", "year").alias("year"))


def merge_overrides(stored: DataFrame, edits: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, o_title, o_authors after ``edits`` (doc_id, title, authors): a row without any override goes."""
    wanted = edits.select("doc_id", F.col("title").alias("e_title"), F.col("authors").alias("e_authors"), F.lit(True).alias("edited"))
    both = stored.join(wanted, "doc_id", "full_outer").join(docs.select("doc_id", "title", "authors"), "doc_id")
    columns = [F.when(F.col("edited"), stored_override(f"e_{c}", c)).otherwise(F.col(f"o_{c}")).alias(f"o_{c}") for c in ("title", "authors")]
    return both.select("doc_id", *columns).filter("o_title IS NOT NULL OR o_authors IS NOT NULL")


def resolve_prefix(docs: DataFrame, prefixes: DataFrame, columns: Sequence[str], shortest: int = 1) -> DataFrame:
    """prefix, doc_id, status: ok for the one document whose identifier starts so, else missing or ambiguous.

    ``columns`` are tried in order. A stated set of prefixes: it is matched by equi-join on their first
    ``shortest`` characters, which every prefix must have, and then in full; % and _ stand for themselves.
    """
    asked = prefixes.select("prefix").distinct().withColumn("head", F.substring("prefix", 1, shortest))
    found = None
    for k, column in enumerate(columns):
        keyed = docs.select(F.col("doc_id"), F.col(column).cast("string").alias("key")).filter("key IS NOT NULL")
        hit = asked.join(keyed.withColumn("head", F.substring("key", 1, shortest)), "head").filter(F.startswith("key", "prefix"))
        one = hit.groupBy("prefix").agg(F.count_distinct("doc_id").alias("n"), F.min("doc_id").alias("doc_id")).withColumn("place", F.lit(k))
        found = one if found is None else found.unionByName(one)
    first = found.groupBy("prefix").agg(F.min(F.struct("place", "n", "doc_id")).alias("x"))
    out = asked.select("prefix").join(first, "prefix", "left")
    status = F.when(F.col("x").isNull(), "missing").when(F.col("x.n") > 1, "ambiguous").otherwise("ok")
    return out.select("prefix", F.when(status == "ok", F.col("x.doc_id")).alias("doc_id"), status.alias("status"))


def label() -> Column:
    """What a document is called: its title, else its file name."""
    return F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.col("filename"))


def in_collection(docs: DataFrame, kind: str, value: str | None = None, today: str | None = None) -> DataFrame:
    """Documents of a collection: all, a type (format), a date (bucket of the day it was added), or a folder."""
    if kind == "all":
        return docs
    if kind == "type":
        return docs.filter(F.col("format") == value)
    if kind == "date":
        return docs.filter(date_bucket(F.col("added"), F.lit(today).cast("date")) == value)
    if kind == "folder":
        return docs.filter(F.col("folder") == value)
    raise ValueError(f"no collection of kind {kind!r}")


def sorted_documents(docs: DataFrame, by: str) -> DataFrame:
    """Documents with label and author, in one of the orders SORTS; ties by label and identifier."""
    order, column = SORTS[by]
    named = docs.withColumn("label", label()).withColumn("author", F.nullif(author_label(F.col("authors")), F.lit("")))
    return named.orderBy(order(column), "label", "doc_id")


def matching(items: DataFrame, query: str, *texts: str | Column) -> DataFrame:
    """Rows with the query, whatever its case, in one of the texts; a blank query matches all."""
    needle = query.strip().lower()
    if not needle:
        return items
    hit = F.lit(False)
    for text in texts:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), F.lit(needle))
    return items.filter(hit)


def count_groups(docs: DataFrame, group: Column) -> DataFrame:
    """value, n: documents of each value, null left out."""
    return docs.groupBy(group.alias("value")).agg(F.count("*").alias("n")).filter("value IS NOT NULL")


def has_every(docs: DataFrame, units: DataFrame, selected: Sequence[str]) -> DataFrame:
    """Documents that have every selected unit (doc_id, name); all documents where none is selected."""
    if not selected:
        return docs
    own = units.filter(F.col("name").isin(*selected)).groupBy("doc_id").agg(F.count_distinct("name").alias("n"))
    return docs.join(own.filter(F.col("n") == len(set(selected))), "doc_id", "left_semi")


def facets(docs: DataFrame, units: DataFrame, selected: Sequence[str]) -> DataFrame:
    """name, n, state: every unit of ``docs`` with its count among the documents that have all selected ones.

    ``state`` is 0 for selected units, 1 for those that narrow the choice, 2 for those that empty it.
    """
    base = units.join(docs.select("doc_id"), "doc_id", "left_semi").distinct()
    held = has_every(docs, units, selected).select("doc_id")
    inside = base.join(held, "doc_id", "left_semi").groupBy("name").agg(F.count("*").alias("n"))
    out = base.select("name").distinct().join(inside, "name", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("state", F.when(F.col("name").isin(*selected), 0).when(F.col("n") > 0, 1).otherwise(2))


def canonical_map(families: DataFrame) -> DataFrame:
    """member, canonical: each name of a family (canonical, members), its canonical one too, folded; the last family
    by canonical name has a name that several claim."""
    names = families.select("canonical", F.explode(F.concat("members", F.array("canonical"))).alias("name"))
    return names.groupBy(F.lower("name").alias("member")).agg(F.max("canonical").alias("canonical"))


def family_units(keywords: DataFrame, mapping: DataFrame) -> DataFrame:
    """doc_id, name: the distinct families of each document's keywords; a keyword of none stands for itself."""
    both = keywords.withColumn("member", F.lower("name")).join(mapping, "member", "left")
    return both.select("doc_id", F.coalesce("canonical", "name").alias("name")).distinct()


def unit_counts(units: DataFrame) -> DataFrame:
    """name, n: distinct documents of each unit."""
    return units.groupBy("name").agg(F.count_distinct("doc_id").alias("n"))


def rare_facets(counts: DataFrame, selected: Sequence[str], most: int = 1) -> DataFrame:
    """``counts`` with rare: few documents and not selected; where that holds for all, for none."""
    rare = (F.col("n") <= most) & ~F.col("name").isin(*selected)
    any_common = counts.agg(F.coalesce(F.bool_or(~rare), F.lit(False)).alias("some"))
    return counts.crossJoin(F.broadcast(any_common)).withColumn("rare", rare & F.col("some")).drop("some")


def remap_selection(selected: DataFrame, mapping: DataFrame, units: DataFrame) -> DataFrame:
    """place, name: the selection (place, name) in terms of families, each once at its first place; what no document has goes."""
    both = selected.withColumn("member", F.lower("name")).join(mapping, "member", "left")
    new = both.groupBy(F.coalesce("canonical", "name").alias("name")).agg(F.min("place").alias("place"))
    return new.join(units.select("name").distinct(), "name", "left_semi").select("place", "name")


def ordered_units(units: DataFrame, active: Sequence[str]) -> DataFrame:
    """Units (doc_id, place, name) with a new place in their document: active ones first, else as before."""
    rank = F.struct(F.when(F.col("name").isin(*active), 0).otherwise(1).alias("r"), "place", "name")
    listed = units.groupBy("doc_id").agg(F.array_sort(F.collect_list(rank)).alias("u"))
    return listed.select("doc_id", F.posexplode("u").alias("place", "x")).select("doc_id", "place", F.col("x.name").alias("name"))


def inherited_families(families: DataFrame, units: DataFrame) -> DataFrame:
    """Families (canonical, members) with inherited: no member and no document."""
    counts = unit_counts(units).withColumnRenamed("name", "canonical")
    both = families.join(counts, "canonical", "left")
    return both.withColumn("inherited", (F.size("members") == 0) & F.col("n").isNull()).drop("n")


def folder_counts(folders: DataFrame, links: DataFrame, docs: DataFrame) -> DataFrame:
    """folder, n: every folder with its distinct documents that are not archived, 0 where there are none."""
    held = links.select("folder", "doc_id").distinct().join(live(docs).select("doc_id"), "doc_id", "left_semi").groupBy("folder").agg(F.count("*").alias("n"))
    return folders.select("folder").distinct().join(held, "folder", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def folder_documents(links: DataFrame, docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, doc_hash of a folder's documents that are not archived: a scope, empty where the folder is."""
    own = links.filter(F.col("folder") == folder).select("doc_id").distinct()
    return live(docs).join(own, "doc_id", "left_semi").select("doc_id", "doc_hash")


def add_to_folder(links: DataFrame, docs: DataFrame, folder: str, ids: DataFrame) -> DataFrame:
    """Links with those of ``ids`` added that exist and are not in the folder yet."""
    fresh = ids.select("doc_id").distinct().join(docs.select("doc_id"), "doc_id", "left_semi").withColumn("folder", F.lit(folder))
    return links.select("doc_id", "folder").unionByName(fresh.join(links, ["doc_id", "folder"], "left_anti").select("doc_id", "folder"))


def remove_from_folder(links: DataFrame, folder: str, ids: DataFrame) -> DataFrame:
    gone = ids.select("doc_id").distinct().withColumn("folder", F.lit(folder))
    return links.join(gone, ["doc_id", "folder"], "left_anti").select("doc_id", "folder")


def create_named(table: DataFrame, names: DataFrame) -> DataFrame:
    """``table`` (name, ...) with the names that it lacks, however they are cased; blank ones are not taken."""
    known = table.select(casefold(F.trim("name")).alias("k")).distinct()
    fresh = names.select(F.trim("name").alias("name")).filter("name <> ''").withColumn("k", casefold(F.col("name")))
    first = fresh.groupBy("k").agg(F.min("name").alias("name")).join(known, "k", "left_anti").select("name")
    return table.unionByName(first, allowMissingColumns=True)


def search_everything(chats: DataFrame, docs: DataFrame, query: str, recent: int = 6, most: int = 8) -> DataFrame:
    """kind, id, label, total: conversations (id, label, last, archived) and documents for one query.

    Without a query the latest conversations that are not archived; else the hits of both, ``most`` of
    each by label and identifier (conversations latest first), with the number of all hits.
    """
    out = chats.sparkSession.createDataFrame([], "kind string, id long, label string, total long")
    if not query.strip():
        latest = chats.filter(~F.coalesce("archived", F.lit(False)))
        top = latest.orderBy(F.desc("last"), "id").limit(recent)
        return out.unionByName(top.select(F.lit("chat").alias("kind"), "id", "label", F.lit(None).cast("long").alias("total")))
    hits = matching(chats, query, "label")
    found = docs.select(F.col("doc_id").alias("id"), label().alias("label"), "filename", "authors")
    for kind, table, order in (("chat", hits, (F.desc("last"), F.asc("id"))), ("document", matching(found, query, "label", "filename", "authors"), (F.asc("label"), F.asc("id")))):
        total = table.agg(F.count("*").alias("total"))
        top = table.orderBy(*order).limit(most).crossJoin(F.broadcast(total))
        out = out.unionByName(top.select(F.lit(kind).alias("kind"), "id", "label", "total"))
    return out


def coverage(docs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """field, present, share: in how many documents each field is neither null nor blank."""
    present = [F.count_if(F.trim(F.col(c).cast("string")) != "").alias(c) for c in columns]
    counted = docs.agg(F.count("*").alias("all"), *present)
    stacked = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("present")) for c in columns)))
    return counted.select("all", stacked.alias("x")).select("x.field", "x.present", F.round(F.col("x.present") / F.nullif("all", F.lit(0)), 6).alias("share"))


def chunk_spread(docs: DataFrame) -> DataFrame:
    """format, n, fewest, most, mean of chunks."""
    return docs.groupBy("format").agg(F.count("*").alias("n"), F.min("chunks").alias("fewest"), F.max("chunks").alias("most"), F.round(F.avg("chunks"), 6).alias("mean"))


def unhealthy(docs: DataFrame, events: DataFrame) -> DataFrame:
    """doc_id, health, last_check of broken and marginal documents; events are doc_id, kind, day."""
    last = events.filter("kind = 'backfill_health'").groupBy("doc_id").agg(F.max("day").alias("last_check"))
    return docs.filter(F.col("health").isin("broken", "marginal")).select("doc_id", "health").join(last, "doc_id", "left")


def store_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """doc_hash, problem: what two stores (doc_hash, doc_id, chunks) do not have alike."""
    both = a.select("doc_hash", F.col("doc_id").alias("a_id"), F.col("chunks").alias("a_n")).join(b.select("doc_hash", F.col("doc_id").alias("b_id"), F.col("chunks").alias("b_n")), "doc_hash", "full_outer")
    problem = F.when(F.col("b_id").isNull(), "only_in_a").when(F.col("a_id").isNull(), "only_in_b").when(F.col("a_id") != F.col("b_id"), "other_id").when(F.col("a_n") != F.col("b_n"), "other_count")
    return both.select("doc_hash", problem.alias("problem")).filter("problem IS NOT NULL")
