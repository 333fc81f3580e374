"""Answers and what is recorded of them: claims, reviews, exports, and how they are shown.

Answers are (answer, text), sources (answer, n, filename, page, score, excerpt) with n from 1, claims
(answer, claim, text, numbers, marker, decision, edited). A null text has no sentences; a number
beyond the sources resolves to none; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import cited_numbers, claim_marker, split_sentences

# What is shown with a claim, the decisions that may be made, the states of an export.
BADGES = {"ok": "", "weak": " ⚠ weakly grounded", "unsupported": " ⚠ unsupported"}
DECISIONS = ("pending", "accepted", "rejected", "edited")
HEALTH_BADGES = {"healthy": "🟢", "marginal": "🟡", "broken": "🔴"}
EXCERPT, PREVIEW = 300, 800


def lookup(value: Column, table: dict[str, str], default: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), value), F.lit(default))


def segment_claims(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """answer, claim, text, numbers, marker: each sentence with the sources that it cites, each once in order."""
    scores = sources.groupBy("answer").agg(F.array_sort(F.collect_list(F.struct("n", "score"))).alias("s"))
    rows = answers.select("answer", F.posexplode(split_sentences(F.col("text"))).alias("claim", "text")).join(scores, "answer", "left")
    numbers = F.array_distinct(cited_numbers(F.col("text")))
    listed = F.coalesce(F.transform("s", lambda x: x["score"]), F.array().cast("array<double>"))
    out = rows.withColumn("numbers", numbers).withColumn("scores", listed)
    return out.select("answer", "claim", "text", F.array_join(F.transform("numbers", lambda n: n.cast("string")), ",").alias("numbers"), claim_marker(F.col("numbers"), F.col("scores")).alias("marker"))


def claim_citations(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """answer, claim, n, filename, page of every number that a claim cites; null beyond the sources."""
    each = claims.filter("numbers <> ''").select("answer", "claim", F.explode(F.split("numbers", ",")).alias("n")).withColumn("n", F.col("n").cast("int"))
    return each.join(sources.select("answer", "n", "filename", "page"), ["answer", "n"], "left").select("answer", "claim", "n", "filename", "page")


def record_claims(stored: DataFrame, claims: DataFrame) -> DataFrame:
    """Stored claims and the new ones, which are pending."""
    return stored.unionByName(claims.withColumn("decision", F.lit("pending")).withColumn("edited", F.lit(None).cast("string")))


def adjudicate(stored: DataFrame, decisions: DataFrame) -> DataFrame:
    """Stored claims after ``decisions`` (answer, claim, to, words); words are kept for edited ones only, unknown decisions change nothing."""
    fine = decisions.filter(F.col("to").isin(*DECISIONS)).select("answer", "claim", "to", "words")
    both = stored.join(fine, ["answer", "claim"], "left")
    edited = F.when(F.col("to") == "edited", F.col("words")).when(F.col("to").isNull(), F.col("edited"))
    return both.withColumn("edited", edited).withColumn("decision", F.coalesce("to", "decision")).drop("to", "words")


def flagged_claims(claims: DataFrame) -> DataFrame:
    """answer, claim, badge of claims that are not well grounded."""
    return claims.filter("marker <> 'ok'").select("answer", "claim", F.trim(lookup(F.col("marker"), BADGES, "")).alias("badge"))


def interpretation(claims: DataFrame) -> DataFrame:
    """answer, markdown: all claims of an answer as a numbered list with citations and badges."""
    cites = F.when(F.col("numbers") != "", F.concat(F.lit(" ["), F.replace("numbers", F.lit(","), F.lit(", ")), F.lit("]"))).otherwise("")
    line = F.concat((F.col("claim") + 1).cast("string"), F.lit(". "), "text", cites, lookup(F.col("marker"), BADGES, ""))
    listed = claims.groupBy("answer").agg(F.array_sort(F.collect_list(F.struct("claim", line.alias("line")))).alias("l"))
    return listed.select("answer", F.array_join(F.concat(F.array(F.lit("**AI interpretation** — the model's synthesis (review each claim):")), F.transform("l", lambda x: x["line"])), "\n").alias("markdown"))


def place_of(filename: Column, page: Column) -> Column:
    return F.concat(F.coalesce(F.nullif(filename, F.lit("")), F.lit("unknown source")), F.when(page > 0, F.concat(F.lit(", p."), page.cast("string"))).otherwise(""))


def evidence(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """answer, markdown: the retrieved passages with where they stand and how relevant they are."""
    score = F.when(F.col("score").isNotNull(), F.format_string(" · relevance %.2f", "score")).otherwise("")
    line = F.concat(F.col("n").cast("string"), F.lit(". *"), place_of(F.col("filename"), F.col("page")), F.lit("*"), score)
    quote = F.when(F.trim("excerpt") != "", F.concat(F.lit("\n   > "), F.trim("excerpt"))).otherwise("")
    listed = sources.groupBy("answer").agg(F.array_sort(F.collect_list(F.struct("n", F.concat(line, quote).alias("line")))).alias("l"))
    out = answers.select("answer").join(listed, "answer", "left")
    head = F.array(F.lit("**Evidence** — what your sources say:"))
    return out.select("answer", F.when(F.col("l").isNull(), "**Evidence** — no sources retrieved.").otherwise(F.array_join(F.concat(head, F.transform("l", lambda x: x["line"])), "\n")).alias("markdown"))


def banner(weak: Column, clustered: Column, few: Column) -> Column:
    """A warning over an answer; null where there is nothing to warn of."""
    reasons = F.array_compact(F.array(F.when(weak, "weak match"), F.when(clustered, "sources hard to tell apart"), F.when(few, "few sources")))
    return F.when(F.size(reasons) > 0, F.concat(F.lit("⚠ "), F.array_join(reasons, "; "), F.lit(" — interpret with caution.")))


def source_line(n: Column, filename: Column, page: Column, figure: Column) -> Column:
    return F.concat(F.lit("- ["), n.cast("string"), F.lit("] "), F.coalesce(filename, F.lit("?")), F.when(page > 0, F.concat(F.lit(", p."), page.cast("string"))).otherwise(""), F.when(figure, " 🖼").otherwise(""))


def distinct_names(sources: DataFrame) -> DataFrame:
    """answer, place, filename: each file of an answer's sources once, where it first stands."""
    first = sources.filter("filename IS NOT NULL").groupBy("answer", "filename").agg(F.min("n").alias("n"))
    listed = first.groupBy("answer").agg(F.array_sort(F.collect_list(F.struct("n", "filename"))).alias("f"))
    return listed.select("answer", F.posexplode("f").alias("place", "x")).select("answer", "place", F.col("x.filename").alias("filename"))


def source_views(sources: DataFrame) -> DataFrame:
    """answer, n, excerpt, preview, score: what is recorded of a passage and what is shown of it."""
    return sources.select("answer", "n", F.substring("excerpt", 1, EXCERPT).alias("excerpt"), F.substring("excerpt", 1, PREVIEW).alias("preview"), F.round("score", 4).alias("score"))


def nth_source(sources: DataFrame, asked: DataFrame) -> DataFrame:
    """answer, n, filename, status of asked sources: 200 where there is one, else 404."""
    both = asked.select("answer", "n").join(sources.select("answer", "n", "filename", F.lit(200).alias("there")), ["answer", "n"], "left")
    return both.select("answer", "n", "filename", F.coalesce("there", F.lit(404)).alias("status"))


def conversation_markdown(turns: DataFrame) -> DataFrame:
    """conv_id, markdown: all turns of each conversation, in order, with their role."""
    body = F.concat(F.lit("**"), F.initcap("role"), F.lit(":** "), F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.lit("_(no answer)_")))
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", body.alias("b")))).alias("l"))
    return listed.select("conv_id", F.array_join(F.transform("l", lambda x: F.concat(F.lit("## Turn "), x["turn"].cast("string"), F.lit("\n"), x["b"])), "\n\n").alias("markdown"))


def history(turns: DataFrame, last: int = 6) -> DataFrame:
    """conv_id, history: the last turns of each conversation as lines of role and text."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    got = turns.groupBy("conv_id").agg(ordered.alias("l")).withColumn("l", F.slice("l", F.greatest(F.size("l") - (last - 1), F.lit(1)), last))
    return got.select("conv_id", F.array_join(F.transform("l", lambda x: F.concat(F.initcap(x["role"]), F.lit(": "), F.coalesce(x["text"], F.lit("")))), "\n").alias("history"))


def set_flags(stored: DataFrame, edits: DataFrame) -> DataFrame:
    """Conversation flags (conv_id, pinned, archived, deleted, title) after edits of the same columns: a null leaves as it is, a blank title clears."""
    names = ("pinned", "archived", "deleted", "title")
    both = stored.join(edits.select("conv_id", *(F.col(c).alias(f"e_{c}") for c in names)), "conv_id", "full_outer")
    flags = [F.coalesce(F.col(f"e_{c}"), F.col(c), F.lit(False)).alias(c) for c in names[:3]]
    title = F.when(F.col("e_title").isNull(), F.col("title")).otherwise(F.nullif(F.trim("e_title"), F.lit("")))
    return both.select("conv_id", *flags, title.alias("title"))


def prompt_block(documents: DataFrame) -> DataFrame:
    """answer, prompt: numbered passages (answer, n, filename, excerpt), apart by rules."""
    one = F.concat(F.lit("[Source "), F.col("n").cast("string"), F.lit("] "), F.coalesce("filename", F.lit("?")), F.lit("\n"), F.coalesce("excerpt", F.lit("")))
    listed = documents.groupBy("answer").agg(F.array_sort(F.collect_list(F.struct("n", one.alias("b")))).alias("l"))
    return listed.select("answer", F.array_join(F.transform("l", lambda x: x["b"]), "\n\n---\n\n").alias("prompt"))
