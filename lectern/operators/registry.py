"""The ingest registry: which files there are, what is to be done with each, and what rows they leave.

Files are (rel_path, size, mtime), registry rows (rel_path, excluded), documents (rel_path, doc_hash).
Paths are relative, with forward slashes. Null paths are not files; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import file_status

# The formats that can be read, and what to do about some others.
FORMATS = ("pdf", "epub", "html", "htm", "docx", "odt", "rtf", "md", "txt")
ADVICE = {"doc": "convert to docx", "pages": "convert to docx", "mobi": "convert to epub", "azw3": "convert to epub"}


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def is_supported(path: Column) -> Column:
    return suffix(path).isin(*FORMATS)


def format_advice(path: Column) -> Column:
    """What to do with a file that cannot be read; null where it can be."""
    known = F.create_map(*(F.lit(x) for pair in ADVICE.items() for x in pair))
    return F.when(~is_supported(path), F.coalesce(F.try_element_at(known, suffix(path)), F.lit("unsupported")))


def normalize_path(path: Column) -> Column:
    return F.regexp_replace(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), r"^(?:\./)+", "")


def path_problem(path: Column) -> Column:
    """absolute, traversal or unsupported; null for a path that may be asked for."""
    return F.when(path.rlike(r"^(?:/|[A-Za-z]:)"), "absolute").when(path.rlike(r"(?:^|/)\.\.(?:/|$)"), "traversal").when(~is_supported(path), "unsupported")


def validate_selection(requested: DataFrame, known: DataFrame) -> DataFrame:
    """path, verdict of each distinct path asked for: a problem, unknown, or valid."""
    asked = requested.select(normalize_path(F.col("path")).alias("path")).distinct()
    there = known.select(F.col("rel_path").alias("path"), F.lit(True).alias("there")).distinct()
    verdict = F.coalesce(path_problem(F.col("path")), F.when(F.col("there"), "valid").otherwise("unknown"))
    return asked.join(there, "path", "left").select("path", verdict.alias("verdict"))


def scan(files: DataFrame, registry: DataFrame, docs: DataFrame, fresh: DataFrame) -> DataFrame:
    """rel_path, size, excluded, status of every file that can be read and every registered one.

    ``fresh`` has the paths whose stored text is up to date. A file on disk is new, ingested or
    changed; a registered one that is not on disk is missing.
    """
    there = files.filter(is_supported(F.col("rel_path"))).select("rel_path", "size", F.lit(True).alias("there"))
    rows = there.join(registry.select("rel_path", "excluded"), "rel_path", "full_outer")
    rows = rows.join(docs.select("rel_path", F.lit(True).alias("has_doc")).distinct(), "rel_path", "left").join(fresh.select("rel_path", F.lit(True).alias("fresh")).distinct(), "rel_path", "left")
    flag = [F.coalesce(c, F.lit(False)) for c in ("there", "has_doc", "fresh")]
    return rows.select("rel_path", "size", F.coalesce("excluded", F.lit(False)).alias("excluded"), file_status(*flag).alias("status"))


def plan(scanned: DataFrame, selection: DataFrame | None = None) -> DataFrame:
    """action, n: how many files would be added, embedded again, skipped or are excluded; a selection overrides exclusion."""
    rows = scanned.filter("status <> 'missing'")
    if selection is not None:
        rows = rows.join(selection.select(F.col("path").alias("rel_path")).distinct(), "rel_path", "left_semi").withColumn("excluded", F.lit(False))
    action = F.when(F.col("excluded"), "excluded").when(F.col("status") == "new", "would_add").when(F.col("status") == "changed", "would_reembed").otherwise("skip_unchanged")
    return rows.groupBy(action.alias("action")).agg(F.count("*").alias("n"))


def set_excluded(registry: DataFrame, paths: DataFrame, excluded: bool) -> DataFrame:
    """The registry with the flag of the given paths set; unknown paths change nothing."""
    marked = paths.select("rel_path", F.lit(True).alias("hit")).distinct()
    flag = F.when(F.col("hit"), F.lit(excluded)).otherwise(F.col("excluded"))
    return registry.join(marked, "rel_path", "left").select("rel_path", flag.alias("excluded"))


def stale_reason(files: DataFrame, cache: DataFrame, fingerprint: str) -> DataFrame:
    """rel_path, reason a stored text (rel_path, c_mtime, c_fingerprint) is not up to date; null where it is."""
    both = files.join(cache, "rel_path", "left")
    reason = F.when(F.col("c_mtime").isNull(), "no_cache").when(F.col("c_mtime") < F.col("mtime"), "source_changed").when(~F.col("c_fingerprint").eqNullSafe(F.lit(fingerprint)), "extractor_changed")
    return both.select("rel_path", reason.alias("reason"))


def rebuild_sweep(known: DataFrame, reproduced: DataFrame, files: DataFrame) -> DataFrame:
    """doc_hash, why of rows known before a rebuild (doc_hash, rel_path) to delete: stale where their source gave
    another row, gone where it is no more; rows of sources that merely failed stay."""
    left = known.join(reproduced.select("doc_hash"), "doc_hash", "left_anti")
    again = reproduced.select("rel_path", F.lit(True).alias("again")).distinct()
    there = files.select("rel_path", F.lit(True).alias("there")).distinct()
    why = F.when(F.col("again"), "stale").when(F.col("there").isNull(), "gone")
    return left.join(again, "rel_path", "left").join(there, "rel_path", "left").select("doc_hash", why.alias("why")).filter("why IS NOT NULL")


def merge_manifest(stored: DataFrame, scanned: DataFrame) -> DataFrame:
    """filename, url, sha, size: the scan's digest and size win, a url that was known stays, new files are added."""
    both = stored.select("filename", "url", F.col("sha").alias("o_sha"), F.col("size").alias("o_size")).join(scanned.select("filename", F.col("sha").alias("n_sha"), F.col("size").alias("n_size")), "filename", "full_outer")
    return both.select("filename", "url", F.coalesce("n_sha", "o_sha").alias("sha"), F.coalesce("n_size", "o_size").alias("size"))


def enrich_urls(entries: DataFrame, public: DataFrame) -> DataFrame:
    """Entries without url take the public list's, by digest first, then by name."""
    by_sha = public.groupBy("sha").agg(F.min("url").alias("url_s"))
    by_name = public.groupBy("filename").agg(F.min("url").alias("url_f"))
    both = entries.join(by_sha, "sha", "left").join(by_name, "filename", "left")
    return both.select("filename", F.coalesce("url", "url_s", "url_f").alias("url"), "sha", "size")


def verify_manifest(entries: DataFrame, found: DataFrame) -> DataFrame:
    """filename, outcome: present, mismatch by digest, would_download or no_url; without a digest any content will do."""
    both = entries.join(found.select("filename", F.col("sha").alias("f_sha")), "filename", "left")
    outcome = F.when(F.col("f_sha").isNull(), F.when(F.col("url").isNull(), "no_url").otherwise("would_download")).when(F.col("sha").isNull() | (F.col("sha") == F.col("f_sha")), "present").otherwise("mismatch")
    return both.select("filename", outcome.alias("outcome"))


def match_pins(pins: DataFrame, files: DataFrame, docs: DataFrame) -> DataFrame:
    """filename, n_docs, ambiguous of files that are pinned sources by size and digest, with the library's rows of that name."""
    hit = files.join(pins.select("size", "sha").distinct(), ["size", "sha"], "left_semi")
    rows = docs.groupBy("filename").agg(F.count("*").alias("n_docs"))
    return hit.join(rows, "filename", "left").select("filename", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), (F.coalesce("n_docs", F.lit(0)) > 1).alias("ambiguous"))


def newer_version(candidate: Column, current: Column) -> Column:
    """Whether one version (v1.2.3) is newer than another; false where either is none."""

    def parts(v: Column) -> Column:
        return F.transform(F.array(*(F.regexp_extract(v, r"^v?(\d+)\.(\d+)(?:\.(\d+))?$", k) for k in (1, 2, 3))), lambda x: F.coalesce(F.nullif(x, F.lit("")), F.lit("0")).cast("int"))

    known = candidate.rlike(r"^v?\d+\.\d+(?:\.\d+)?$") & current.rlike(r"^v?\d+\.\d+(?:\.\d+)?$")
    return F.coalesce(known & (parts(candidate) > parts(current)), F.lit(False))
