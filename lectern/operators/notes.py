"""Notes on topics, kept up to date: only what has changed since the last run is written.

A topic is a cluster of documents; its name comes from a digest of its members, taken over hash
prefixes first, so no member list is gathered whole. A note has a title, the documents it lists, links
to topics that similarity edges lead to, and what it lacks. A run compares the notes' digests with
those stored, writes the new and the changed ones as a part of its own, and marks those gone.

Documents without cluster or hash are in no note; a document in two clusters is in both. Edges may be
given either way, repeat, or lead nowhere.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators.communities import attached
from lectern.operators.scratch import materialize

STORED = "topic string, digest string, title string, markdown string, action string, run long"
#: A topic with fewer documents is thin.
FEW_SOURCES = 3
#: Documents and links that a note lists; the tables of members and links have all.
LISTED = 50


def named(clusters: DataFrame, docs: DataFrame) -> DataFrame:
    """cluster, doc, topic: every member with the name of its topic. ``clusters`` has cluster, doc; ``docs`` doc, doc_hash."""
    members = materialize(attached(clusters.na.drop().distinct(), docs.select("doc", "doc_hash").filter("doc_hash IS NOT NULL").dropDuplicates(["doc"]), "doc"), "members")
    parts = members.groupBy("cluster", F.substring("doc_hash", 1, 3).alias("prefix")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("doc_hash")), ","), 256).alias("d"))
    whole = F.array_sort(F.collect_list(F.struct("prefix", "d")))["d"]  # 4096 at most
    topics = parts.groupBy("cluster").agg(F.concat(F.lit("topic-"), F.substring(F.sha2(F.array_join(whole, ","), 256), 1, 10)).alias("topic"))
    return attached(members.select("cluster", "doc"), topics, "cluster")


def links(members: DataFrame, edges: DataFrame) -> DataFrame:
    """topic, other: topics that an edge (a, b) leads from one to the other, both ways."""
    of = members.groupBy("doc").agg(F.collect_set("topic").alias("topics"))
    ends = attached(attached(edges.select("a", "b").distinct(), of.select(F.col("doc").alias("a"), F.col("topics").alias("x")), "a"), of.select(F.col("doc").alias("b"), F.col("topics").alias("y")), "b")
    pairs = ends.select(F.explode("x").alias("topic"), "y").select("topic", F.explode("y").alias("other")).filter("topic <> other")
    return pairs.unionByName(pairs.select(F.col("other").alias("topic"), F.col("topic").alias("other"))).distinct()


def titles(members: DataFrame, keywords: DataFrame, docs: DataFrame) -> DataFrame:
    """topic, title: the keyword (doc, keyword) of most of its documents, the first of equals; else the first document's title."""
    counted = members.join(keywords.distinct(), "doc").groupBy("topic", "keyword").agg(F.count("*").alias("n"))
    best = counted.groupBy("topic").agg(F.min(F.struct((-F.col("n")).alias("n"), "keyword"))["keyword"].alias("keyword"))
    first = members.join(docs.select("doc", "title"), "doc").groupBy("topic").agg(F.min(F.struct("doc", "title"))["title"].alias("title"))
    return first.join(best, "topic", "left").select("topic", F.coalesce(F.initcap("keyword"), "title", "topic").alias("title"))


def listed(rows: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """``key``, lines: the first LISTED lines of each key, as one text."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    first = rows.withColumn("_place", place).filter(F.col("_place") <= LISTED)
    return first.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_place", line))), lambda x: x[line]), "\n").alias("lines"))


def assemble(clusters: DataFrame, docs: DataFrame, keywords: DataFrame, edges: DataFrame) -> DataFrame:
    """topic, digest, title, markdown of every topic; ``docs`` has doc, doc_hash, title."""
    members = materialize(named(clusters, docs), "members")
    named_topics = materialize(titles(members, keywords, docs), "titles")
    to = materialize(links(members, edges), "links")
    n = members.groupBy("topic").agg(F.count_distinct("doc").alias("n_docs"))
    n_links = to.groupBy("topic").agg(F.count("*").alias("n_links"))
    sources = listed(members.join(docs.select("doc", "title"), "doc").select("topic", "doc", F.concat(F.lit("- "), F.coalesce("title", F.lit("(untitled)"))).alias("line")).distinct(), "topic", "doc", "line")
    others = listed(to.join(named_topics.select(F.col("topic").alias("other"), F.col("title").alias("to")), "other").select("topic", "other", F.concat(F.lit("- [["), "other", F.lit("|"), "to", F.lit("]]")).alias("line")), "topic", "other", "line")
    out = named_topics.join(n, "topic").join(n_links, "topic", "left").join(sources, "topic", "left").join(others.withColumnRenamed("lines", "related"), "topic", "left")
    lacks = F.array_compact(F.array(F.when(F.col("n_docs") < FEW_SOURCES, "citation_thin"), F.when(F.col("n_docs") == 1, "single_source"), F.when(F.col("n_links").isNull(), "no_links")))
    head = [F.concat(F.lit(f"{k}: "), v) for k, v in (("topic_id", F.col("topic")), ("title", F.to_json(F.array("title"))), ("n_docs", F.col("n_docs").cast("string")), ("gaps", F.concat(F.lit("["), F.array_join(lacks, ", "), F.lit("]"))))]
    body = [F.concat(F.lit("# "), F.col("title")), F.concat(F.lit("## Sources\n\n"), F.col("lines")), F.concat(F.lit("## Related\n\n"), F.col("related"))]
    text = F.concat(F.lit("---\n"), F.concat_ws("\n", *head), F.lit("\n---\n\n"), F.concat_ws("\n\n", *body), F.lit("\n"))
    return out.select("topic", "title", text.alias("markdown")).withColumn("digest", F.sha2("markdown", 256)).select("topic", "digest", "title", "markdown")


def stored(spark: SparkSession, where: str) -> DataFrame:
    """STORED, all rows of all runs."""
    try:
        return spark.read.schema(STORED).option("recursiveFileLookup", "true").parquet(where)
    except AnalysisException:
        return spark.createDataFrame([], STORED)


def current(spark: SparkSession, where: str, before: int | None = None) -> DataFrame:
    """The notes that are there, or were before a run: the last row of each topic, unless it says removed."""
    columns = [c.split()[0] for c in STORED.split(", ")][1:]
    rows = stored(spark, where)
    last = (rows if before is None else rows.filter(F.col("run") < before)).groupBy("topic").agg(F.max_by(F.struct(*columns), "run").alias("r"))
    return last.select("topic", *(f"r.{c}" for c in columns)).filter("action <> 'removed'")


def refresh(notes: DataFrame, where: str, run: int) -> dict[str, int]:
    """Bring the stored notes up to ``notes``; runs have ascending numbers, and one that is repeated overwrites its own part. Says how many notes of each kind were written."""
    spark = notes.sparkSession
    notes = materialize(notes, "notes")
    before = materialize(current(spark, where, run).select("topic", "digest"), "before")
    known = before.select("topic", F.col("digest").alias("old"))
    there = notes.join(known, "topic", "left").filter("old IS NULL OR old <> digest").withColumn("action", F.when(F.col("old").isNull(), "added").otherwise("changed")).drop("old")
    gone = before.join(notes.select("topic"), "topic", "left_anti").withColumn("action", F.lit("removed"))
    rows = materialize(there.unionByName(gone, allowMissingColumns=True).withColumn("run", F.lit(run).cast("long")), "changes")
    counted = {r.action: r.n for r in rows.groupBy("action").agg(F.count("*").alias("n")).collect()}
    if counted:
        rows.select(*(c.split()[0] for c in STORED.split(", "))).write.mode("overwrite").parquet(f"{where}/run_{run}")
    return counted
