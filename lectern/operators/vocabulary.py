"""The curated vocabulary: keyword links, candidates, concepts and their aliases, and rows written once.

Links are (doc, name, source), concepts (label, aliases, graph_include, kind). Names are compared folded;
null names are none; empty tables give empty results; repeated links count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import casefold


def write_once(stored: DataFrame, fresh: DataFrame, owner: str, force: bool = False) -> DataFrame:
    """Stored rows and the fresh ones of owners that have none yet; with ``force`` fresh owners' rows are replaced."""
    if force:
        return stored.join(fresh.select(owner).distinct(), owner, "left_anti").unionByName(fresh)
    return stored.unionByName(fresh.join(stored.select(owner).distinct(), owner, "left_anti"))


def persist_keywords(links: DataFrame, extracted: DataFrame, force: bool = False) -> DataFrame:
    """Links with the extracted terms (doc, name) of each document; other sources' links always stay."""
    own, others = links.filter("source = 'extracted'"), links.filter("source <> 'extracted'")
    fresh = extracted.select("doc", "name").distinct().withColumn("source", F.lit("extracted"))
    merged = write_once(own, fresh, "doc", force)
    return others.unionByName(merged.join(others.select("doc", "name"), ["doc", "name"], "left_anti"))


def surface_names(concepts: DataFrame) -> DataFrame:
    """k, label: every label and alias, folded, with its concept."""
    names = concepts.select("label", F.explode(F.concat(F.array("label"), "aliases")).alias("n"))
    return names.select(casefold(F.trim("n")).alias("k"), "label").filter("k <> ''").distinct()


def orphan_keywords(keywords: DataFrame, links: DataFrame, concepts: DataFrame) -> DataFrame:
    """name of extracted keywords (name, source) that no document has and no concept is called by."""
    free = keywords.filter("source = 'extracted'").join(links.select("name").distinct(), "name", "left_anti")
    return free.withColumn("k", casefold(F.col("name"))).join(surface_names(concepts).select("k"), "k", "left_anti").select("name")


def name_bigrams(authors: DataFrame) -> DataFrame:
    """k: neighbouring capitalised words of author lists, in either order, folded: names of people, not concepts."""
    words = F.filter(F.split("authors", r"[^\p{L}'-]+"), lambda w: w.rlike(r"^\p{Lu}\p{L}+"))
    pairs = authors.select(F.explode(F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda b, i: F.struct(words[i].alias("a"), b.alias("b")))).alias("p"))
    both = pairs.select(F.explode(F.array(F.concat_ws(" ", "p.a", "p.b"), F.concat_ws(" ", "p.b", "p.a"))).alias("k"))
    return both.select(casefold(F.col("k")).alias("k")).distinct()


def candidates(links: DataFrame, concepts: DataFrame, people: DataFrame) -> DataFrame:
    """name, n_docs, promoted, in_graph, is_person of every linked keyword."""
    counted = links.groupBy("name").agg(F.count_distinct("doc").alias("n_docs")).withColumn("k", casefold(F.col("name")))
    included = concepts.join(surface_names(concepts), "label").groupBy("k").agg(F.bool_or(F.coalesce("graph_include", F.lit(False))).alias("in_graph"), F.lit(True).alias("promoted"))
    out = counted.join(included, "k", "left").join(people.withColumn("is_person", F.lit(True)), "k", "left")
    return out.select("name", "n_docs", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("promoted", "in_graph", "is_person")))


def add_concepts(concepts: DataFrame, fresh: DataFrame) -> DataFrame:
    """Concepts with the fresh ones (label, aliases) by label: a known one gains aliases, a new one is included in the graph."""
    old = concepts.select("label", F.col("aliases").alias("o"), "graph_include", "kind", casefold(F.col("label")).alias("k"))
    new = fresh.groupBy(casefold(F.trim("label")).alias("k")).agg(F.min(F.trim("label")).alias("n_label"), F.array_distinct(F.flatten(F.collect_list("aliases"))).alias("n"))
    both = old.join(new.filter("k <> ''"), "k", "full_outer")
    empty = F.array().cast("array<string>")
    aliases = F.array_sort(F.array_distinct(F.concat(F.coalesce("o", empty), F.coalesce("n", empty))))
    is_new = F.col("label").isNull()
    return both.select(F.coalesce("label", "n_label").alias("label"), aliases.alias("aliases"), F.when(is_new, True).otherwise(F.col("graph_include")).alias("graph_include"), F.when(is_new, "concept").otherwise(F.col("kind")).alias("kind"))


def set_graph_include(concepts: DataFrame, labels: list[str], include: bool) -> DataFrame:
    return concepts.withColumn("graph_include", F.when(F.col("label").isin(*labels), F.lit(include)).otherwise(F.col("graph_include")))


def backfill_graph_include(concepts: DataFrame) -> DataFrame:
    """Unset flags become true for concepts that were made by hand (source)."""
    return concepts.withColumn("graph_include", F.coalesce("graph_include", F.col("source") == "manual"))


def rename_concept(concepts: DataFrame, label: str, new: str) -> DataFrame:
    """The concept under a new label; nothing where another has it already, whatever its case."""
    taken = concepts.filter(casefold(F.col("label")) == casefold(F.lit(new))).filter(F.col("label") != label).isEmpty()
    return concepts.withColumn("label", F.when(F.col("label") == label, F.lit(new)).otherwise(F.col("label"))) if taken else concepts


def remove_alias(concepts: DataFrame, label: str, alias: str) -> DataFrame:
    left = F.filter("aliases", lambda a: casefold(a) != casefold(F.lit(alias)))
    return concepts.withColumn("aliases", F.when(F.col("label") == label, left).otherwise(F.col("aliases")))


def remove_concepts(concepts: DataFrame, labels: list[str]) -> DataFrame:
    return concepts.filter(~F.col("label").isin(*labels))


def fill_metadata(stored: DataFrame, found: DataFrame, key: str, columns: list[str], force: bool = False) -> DataFrame:
    """Stored rows whose null fields take what was found; with ``force`` found values win, but null never does."""
    both = stored.join(found.select(key, *(F.col(c).alias(f"f_{c}") for c in columns)), key, "left")
    filled = {c: F.coalesce(f"f_{c}", c) if force else F.coalesce(c, f"f_{c}") for c in columns}
    return both.withColumns(filled).drop(*(f"f_{c}" for c in columns))


def diff_manifests(old: DataFrame, new: DataFrame) -> DataFrame:
    """key, change: what was added to or removed from a list of keys."""
    added = new.select("key").distinct().join(old.select("key"), "key", "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(old.select("key").distinct().join(new.select("key"), "key", "left_anti").withColumn("change", F.lit("removed")))


def glossary(concepts: DataFrame) -> DataFrame:
    """label, aliases (sorted, without the label), sort_key of concepts, fields left out."""
    rest = F.array_sort(F.filter("aliases", lambda a: casefold(a) != casefold(F.col("label"))))
    return concepts.filter("kind = 'concept'").select("label", F.array_join(rest, ",").alias("aliases"), casefold(F.col("label")).alias("sort_key"))


def graph_vocabulary(concepts: DataFrame) -> DataFrame:
    """label, aliases of concepts that are included in the graph; an unset flag does not include."""
    return concepts.filter("graph_include").select("label", F.array_join(F.array_sort("aliases"), ",").alias("aliases"))
