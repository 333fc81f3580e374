"""A stored sparse index: positional postings by term, document lengths, deletes, and compaction.

The index is a folder of Parquet tables. A fill writes a segment: its documents, and its postings in
partitions by a hash of their term, so a query set reads only its own terms' partitions and row groups.
A delete writes tombstones (segment, document); a compaction writes what is alive of several segments
as one. What an index consists of is told by its manifest, a table of one file: each change writes the
next version of it, last and whole, and readers take the newest. So whatever breaks off before that
leaves the index as it was, and a reader that holds an older version goes on with its tables.

One writer at a time is assumed. Documents without identifier are not indexed; of rows that repeat an
identifier the one with the smallest text hash is; an empty or null text is a document of no terms.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import subtokens
from lectern.operators.index import BROADCAST_PARTS, index_fingerprint, phrase_counts, phrase_parts, query_parts, rank_documents, rank_postings
from lectern.operators.scoring import numbered
from lectern.operators.scratch import materialize

#: Partitions of the postings, unless a fill is told otherwise; a segment keeps its own number.
TERM_BUCKETS = 64
#: Documents whose postings a task holds at once.
DOCS_HELD = 256
#: Tombstones are broadcast up to so many.
BROADCAST_DEAD = 1 << 18
MANIFEST = "version long, segment string, n long, buckets int, dead string"
SCHEMAS = {"postings": "term string, doc long, dl long, positions array<int>, bucket int", "docs": "doc long, dl long"}


def bucket_of(term: Column, buckets: int | Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets) if isinstance(buckets, int) else buckets).cast("int")


def newest(spark: SparkSession, where: str) -> int:
    """The newest version of the manifest, 0 where there is no index yet."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{where}/manifest").agg(F.max("version")).first()[0] or 0
    except AnalysisException:
        return 0


def manifest(spark: SparkSession, where: str) -> list[dict]:
    """The rows of the newest version: segment, its documents, its buckets, and the table of tombstones; one row a segment."""
    last = newest(spark, where)
    if not last:
        return []
    rows = spark.read.schema(MANIFEST).parquet(f"{where}/manifest").filter(F.col("version") == last)
    return [r.asDict() for r in rows.filter("segment IS NOT NULL").collect()]


def swap(spark: SparkSession, where: str, segments: list[dict]) -> None:
    """Write the next version of the manifest. An index without segments has a version with one empty row."""
    version = newest(spark, where) + 1
    rows = [(version, s["segment"], s["n"], s["buckets"], s["dead"]) for s in segments] or [(version, None, 0, 0, None)]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{where}/manifest")


def tombstones(spark: SparkSession, where: str, segments: list[dict]) -> DataFrame | None:
    """segment, doc of all deletes that ``segments`` know of."""
    named = sorted({s["dead"] for s in segments if s["dead"]})
    return spark.read.parquet(*(f"{where}/dead/{d}" for d in named)) if named else None


def read(spark: SparkSession, where: str, what: str, segments: list[dict] | None = None, condition: Column | None = None) -> DataFrame:
    """The living rows of ``docs`` or ``postings``, with their segment; ``condition`` is pushed down to each segment."""
    segments = manifest(spark, where) if segments is None else segments
    if not segments:
        return spark.createDataFrame([], f"{SCHEMAS[what]}, segment string")
    out = None
    for s in segments:
        part = spark.read.schema(SCHEMAS[what]).parquet(f"{where}/segments/{s['segment']}/{what}")
        part = (part if condition is None else part.filter(condition)).withColumn("segment", F.lit(s["segment"]))
        out = part if out is None else out.unionByName(part)
    dead = tombstones(spark, where, segments)
    if dead is None:
        return out
    dead = dead.distinct()
    return out.join(F.broadcast(dead) if dead.count() <= BROADCAST_DEAD else dead, ["segment", "doc"], "left_anti")


def by_term(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, doc, dl, positions of documents (doc, w): each term once for each document."""
    names = ["term", "doc", "dl", "positions"]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
    for batch, a in ((b, a) for b in it for a in range(0, b.num_rows, DOCS_HELD)):
        part = batch.slice(a, DOCS_HELD)
        columns: tuple[list, ...] = ([], [], [], [])
        for doc, words in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            places: dict[str, list[int]] = {}
            for k, word in enumerate(words):
                places.setdefault(word, []).append(k)
            columns[0].extend(places)
            columns[1].extend([doc] * len(places))
            columns[2].extend([len(words)] * len(places))
            columns[3].extend(places.values())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def write_segment(docs: DataFrame, postings: DataFrame, where: str, buckets: int) -> dict | None:
    """A new segment, not in the manifest yet; None where there is no document.

    Postings are sorted by range of bucket, term and document, so that a frequent term's list is spread over tasks.
    """
    name, spark = uuid.uuid4().hex, docs.sparkSession
    docs.write.parquet(f"{where}/segments/{name}/docs")
    n = spark.read.parquet(f"{where}/segments/{name}/docs").count()
    if not n:
        return None
    placed = postings.withColumn("bucket", bucket_of(F.col("term"), buckets))
    ranged = placed.repartitionByRange("bucket", "term", "doc").sortWithinPartitions("bucket", "term", "doc")
    ranged.write.partitionBy("bucket").parquet(f"{where}/segments/{name}/postings")
    return {"segment": name, "n": n, "buckets": buckets, "dead": None}


def fill(docs: DataFrame, where: str, id_col: str = "doc_id", text_col: str = "text", buckets: int = TERM_BUCKETS) -> int:
    """Index the documents that are not in the index yet, and say how many. Their texts are cut into tokens once."""
    spark, segments = docs.sparkSession, manifest(docs.sparkSession, where)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).filter("doc IS NOT NULL")
    chosen = rows.select("doc", F.xxhash64("text").alias("h")).groupBy("doc").agg(F.min("h").alias("h"), F.count("*").alias("copies"))
    if segments:
        chosen = chosen.join(read(spark, where, "docs", segments).select("doc"), "doc", "left_anti")
    chosen = materialize(chosen, "fresh")
    many = chosen.filter("copies > 1")
    fresh = rows.withColumn("h", F.xxhash64("text")).join(chosen.select("doc", "h"), ["doc", "h"], "left_semi")
    if not many.isEmpty():  # only rows that repeat meet again
        twice = fresh.join(many.select("doc"), "doc", "left_semi").dropDuplicates(["doc", "h"])
        fresh = fresh.join(many.select("doc"), "doc", "left_anti").unionByName(twice)
    words = fresh.select("doc", subtokens(F.col("text")).alias("w"))
    postings = materialize(words.filter(F.size("w") > 0).mapInArrow(by_term, "term string, doc long, dl long, positions array<int>"), "postings")
    lengths = postings.groupBy("doc").agg(F.first("dl").alias("dl"))
    every = chosen.select("doc").join(lengths, "doc", "left").select("doc", F.coalesce("dl", F.lit(0)).cast("long").alias("dl"))
    new = write_segment(every, postings, where, buckets)
    if new is None:
        return 0
    swap(spark, where, [*segments, new])
    return new["n"]


def delete(spark: SparkSession, where: str, gone: DataFrame) -> int:
    """Delete the documents of ``gone`` (doc) by tombstones, and say how many were there. They may be filled in anew afterwards."""
    segments = manifest(spark, where)
    if not segments:
        return 0
    own = materialize(read(spark, where, "docs", segments).join(gone.select("doc").distinct(), "doc", "left_semi").select("segment", "doc"), "gone")
    n = own.count()
    if not n:
        return 0
    name, before = uuid.uuid4().hex, tombstones(spark, where, segments)
    (own if before is None else own.unionByName(before).distinct()).write.parquet(f"{where}/dead/{name}")
    swap(spark, where, [s | {"dead": name} for s in segments])
    return n


def compact(spark: SparkSession, where: str, least: int | None = None, buckets: int = TERM_BUCKETS) -> int:
    """Write what is alive of the segments with fewer than ``least`` documents (of all, if None) as one, and say how many segments that replaces.

    Segments that are only one and have no tombstones are left. Until the manifest is swapped nothing has changed.
    """
    segments = manifest(spark, where)
    taken = [s for s in segments if least is None or s["n"] < least]
    if not taken or len(taken) == 1 and not taken[0]["dead"]:
        return 0
    docs, postings = (read(spark, where, what, taken) for what in ("docs", "postings"))
    new = write_segment(docs.select("doc", "dl"), postings.select("term", "doc", "dl", "positions"), where, buckets)
    swap(spark, where, [s for s in segments if s not in taken] + ([new] if new else []))
    return len(taken)


def rebuild(docs: DataFrame, where: str, **options: object) -> int:
    """Index ``docs`` anew and drop all other segments, in one swap; without documents the old index stays and an error is raised."""
    spark = docs.sparkSession
    shadow = f"{where}/rebuild-{uuid.uuid4().hex}"
    n = fill(docs, shadow, **options)
    if not n:
        raise ValueError("there is no document to index")
    made = manifest(spark, shadow)
    moved = [write_segment(read(spark, shadow, "docs", [s]).select("doc", "dl"), read(spark, shadow, "postings", [s]).select("term", "doc", "dl", "positions"), where, s["buckets"]) for s in made]
    swap(spark, where, moved)
    return n


def fingerprint(spark: SparkSession, where: str) -> DataFrame:
    """Sums over the digests of the documents' identifiers: equal for equal sets, whatever their order."""
    return read(spark, where, "docs").agg(index_fingerprint(F.col("doc")).alias("x")).select("x.*")


def is_current(docs: DataFrame, where: str, id_col: str = "doc_id") -> bool:
    """Whether the index holds exactly the given documents."""
    now = docs.select(F.col(id_col).cast("long").alias("doc")).distinct().agg(index_fingerprint(F.col("doc")).alias("x")).select("x.*")
    return now.first() == fingerprint(docs.sparkSession, where).first()


def search(spark: SparkSession, where: str, queries: DataFrame, k: int, query_col: str = "item_id", query_text: str = "text", scope: DataFrame | None = None) -> DataFrame:
    """query, doc, score, rank: BM25 over the index. ``scope`` (doc) limits the candidates; an empty one finds nothing."""
    segments = manifest(spark, where)
    phrases = query_parts(queries, query_col, query_text)
    parts = phrase_parts(phrases)
    n = parts.count()
    found = None
    for buckets in sorted({s["buckets"] for s in segments}):
        own = [s for s in segments if s["buckets"] == buckets]
        asked = [r[0] for r in parts.select(bucket_of(F.col("term"), buckets)).distinct().collect()]  # as many as buckets at most
        part = read(spark, where, "postings", own, F.col("bucket").isin(*asked) if asked else F.lit(False)).drop("bucket", "segment")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = read(spark, where, "postings", []).drop("bucket", "segment")
    totals = read(spark, where, "docs", segments).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    if n <= BROADCAST_PARTS:
        known = numbered(phrases)
        held = found.join(F.broadcast(parts), "term")
        alone = held.filter("n_parts = 1").select("phrase", "doc", "dl", F.size("positions").cast("long").alias("tf"))
        several = phrase_counts(held.filter("n_parts > 1").select("phrase", "n_parts", "i", "doc", "dl", F.explode("positions").alias("pos")))
        names = F.broadcast(spark.createDataFrame([(k, p) for k, p in enumerate(known.names)], "p int, phrase string"))
        each = alone.unionByName(several.select("phrase", "doc", "dl", "tf")).join(names, "phrase").groupBy("doc", "dl").agg(F.collect_list(F.struct("p", F.col("tf").cast("int").alias("tf"))).alias("x"))
        rows = materialize(each.select("doc", "dl", F.col("x.p").alias("ids"), F.col("x.tf").alias("tfs"), F.lit(True).alias("inside")), "met")
        if scope is not None:
            rows = rows.drop("inside").join(scope.select("doc", F.lit(True).alias("inside")).distinct(), "doc", "left")
        return rank_documents(rows, known, totals, k, phrases.schema["query"].dataType.simpleString(), F.coalesce("inside", F.lit(False)))
    met = found.join(parts, "term").select("phrase", "n_parts", "i", "doc", "dl", F.explode("positions").alias("pos"))
    return rank_postings(materialize(met, "met"), phrases, totals, k, scope)
