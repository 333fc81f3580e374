"""Evaluation statistics over long score tables: run, scorer, case, value (null where it was skipped)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scorer_stats(scores: DataFrame, digits: int = 6) -> DataFrame:
    """run, scorer, mean, n_scored, n_skipped."""
    return scores.groupBy("run", "scorer").agg(F.round(F.avg("value"), digits).alias("mean"), F.count("value").alias("n_scored"), F.count_if(F.col("value").isNull()).alias("n_skipped"))


def aggregate_runs(scores: DataFrame, digits: int = 6) -> DataFrame:
    """scorer, n_runs, trial_mean, trial_std (null for one run), pooled_mean, pooled_std, n_scored."""
    run = scores.groupBy("scorer", "run").agg(F.avg("value").alias("m"))
    trials = run.groupBy("scorer").agg(F.count("m").alias("n_runs"), F.round(F.avg("m"), digits).alias("trial_mean"), F.round(F.stddev_samp("m"), digits).alias("trial_std"))
    pooled = scores.groupBy("scorer").agg(F.round(F.avg("value"), digits).alias("pooled_mean"), F.round(F.stddev_samp("value"), digits).alias("pooled_std"), F.count("value").alias("n_scored"))
    return trials.join(pooled, "scorer")


def flaky_cases(scores: DataFrame) -> DataFrame:
    """scorer, case, n_scored, n_skipped of cases that were scored at times and skipped at times."""
    counted = scores.groupBy("scorer", "case").agg(F.count("value").alias("n_scored"), F.count_if(F.col("value").isNull()).alias("n_skipped"))
    return counted.filter("n_scored > 0 AND n_skipped > 0")


def diff_runs(scores: DataFrame, a: int, b: int) -> DataFrame:
    """case, scorer, a, b, delta = b - a for what both runs have."""
    one = [scores.filter(F.col("run") == r).select("case", "scorer", F.col("value").alias(name)) for r, name in ((a, "a"), (b, "b"))]
    return one[0].join(one[1], ["case", "scorer"]).withColumn("delta", F.col("b") - F.col("a"))


def exact_match(expected: Column, answer: Column) -> Column:
    """1 where both are equal but for case and outer white space; null without an expected answer."""
    return F.when(F.lower(F.trim(expected)) == F.lower(F.trim(F.coalesce(answer, F.lit("")))), 1.0).when(expected.isNotNull(), 0.0)


def contains_all(expected: Column, answer: Column) -> Column:
    """The share of expected strings in the answer, whatever their case; null where none is expected."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    return F.when(F.size(expected) > 0, F.size(F.filter(expected, lambda e: F.contains(low, F.lower(e)))) / F.size(expected))


def extra_names(expected: Column, found: Column) -> Column:
    """Found names that no expected one contains or is contained in."""
    return F.filter(found, lambda f: ~F.exists(expected, lambda e: F.contains(F.lower(f), F.lower(e)) | F.contains(F.lower(e), F.lower(f))))


def figure_found(figure: Column, filename: Column, page: Column, found: Column) -> Column:
    """1 where ``found`` (figure, filename, page) has the figure, by identifier or else by file and page; null where none is expected."""
    hit = F.exists(found, lambda x: F.coalesce(x["figure"] == figure, F.lit(False)) | (figure.isNull() & F.coalesce((x["filename"] == filename) & (x["page"] == page), F.lit(False))))
    return F.when(hit, 1.0).when(figure.isNotNull() | filename.isNotNull(), 0.0)


def judge_mean(a: Column, b: Column, c: Column) -> Column:
    """The mean of three marks from 1 to 5; null, skipped, where one is missing or out of range."""
    fine = a.between(1, 5) & b.between(1, 5) & c.between(1, 5)
    return F.when(fine, F.round((a + b + c) / 3, 6))


def weakest(*values: Column) -> Column:
    """The least of the values that are there; null for none."""
    return F.least(*values)


def is_actionable(count: Column, answers: Column, tag: Column, min_count: int = 10, min_docs: int = 5) -> Column:
    return (tag != "none") & (count >= min_count) & (answers >= min_docs)


def coerce_tag(value: Column, known: tuple[str, ...]) -> Column:
    return F.when(F.lower(F.trim(value)).isin(*known), F.lower(F.trim(value))).otherwise("none")


def tag_stats(reviews: DataFrame) -> DataFrame:
    """tag, n, n_answers, share, actionable of reviews (answer, tag)."""
    total = reviews.agg(F.count("*").alias("total"))
    stats = reviews.groupBy("tag").agg(F.count("*").alias("n"), F.count_distinct("answer").alias("n_answers"))
    out = stats.crossJoin(F.broadcast(total)).withColumn("share", F.round(F.col("n") / F.col("total"), 6)).drop("total")
    return out.withColumn("actionable", is_actionable(F.col("n"), F.col("n_answers"), F.col("tag")))


def bias_or_fault(stats: DataFrame, golden: DataFrame, rate: float = 0.2) -> DataFrame:
    """tag, verdict of actionable tags: reviewer_bias where as many golden reviews (tag) have it, else system_fault; unanchored without golden ones."""
    total = golden.agg(F.count("*").alias("total"))
    own = golden.groupBy("tag").agg(F.count("*").alias("g"))
    both = stats.filter("actionable").select("tag").join(own, "tag", "left").crossJoin(F.broadcast(total))
    verdict = F.when(F.col("total") == 0, "unanchored").when(F.coalesce("g", F.lit(0)) / F.col("total") >= rate, "reviewer_bias").otherwise("system_fault")
    return both.select("tag", verdict.alias("verdict"))


def dominant_fault(reviews: DataFrame) -> DataFrame:
    """version, tag, n: the most frequent tag other than none of each prompt version, the first of equals."""
    counted = reviews.filter("tag <> 'none'").groupBy("version", "tag").agg(F.count("*").alias("n"))
    best = counted.groupBy("version").agg(F.min(F.struct((-F.col("n")).alias("m"), "tag")).alias("x"))
    return best.select("version", F.col("x.tag").alias("tag"), (-F.col("x.m")).alias("n"))


def verdict_of(support: Column, grounded: Column, complete: Column) -> Column:
    """fail where a mark is 2 or less, concern where one is 3, else pass; null without marks."""
    low = F.least(support, grounded, complete)
    return F.when(low <= 2, "fail").when(low == 3, "concern").when(low.isNotNull(), "pass")


def run_rows(results: DataFrame) -> DataFrame:
    """run, n_cases, n_failed, started, finished from results (run, case, at, error)."""
    return results.groupBy("run").agg(F.count_distinct("case").alias("n_cases"), F.count("error").alias("n_failed"), F.min("at").alias("started"), F.max("at").alias("finished"))


def latest_runs(runs: DataFrame, limit: int) -> DataFrame:
    return runs.orderBy(F.desc("started"), "run").limit(limit)


def case_scores(scores: DataFrame, run: int) -> DataFrame:
    """case, scorer, value, skipped of one run."""
    return scores.filter(F.col("run") == run).select("case", "scorer", "value", F.col("value").isNull().alias("skipped"))


def largest_changes(diff: DataFrame, k: int) -> DataFrame:
    """The ``k`` rows of a comparison with the largest change either way."""
    return diff.orderBy(F.desc(F.abs("delta")), "case", "scorer").limit(k)


def settings_hash(settings: Column, digits: int = 12) -> Column:
    """The first digits of a digest of a map of settings, whatever the order of its keys."""
    entries = F.array_sort(F.map_entries(settings))
    return F.substring(F.sha2(F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "\n"), 256), 1, digits)


def duplicate_arms(arms: DataFrame) -> DataFrame:
    """arm, same_as: arms (arm, settings) with the settings of an earlier one."""
    hashed = arms.select("arm", settings_hash(F.col("settings")).alias("h"))
    first = hashed.groupBy("h").agg(F.min("arm").alias("same_as"))
    return hashed.join(first, "h").filter("arm <> same_as").select("arm", "same_as")


def crowding(ranked: DataFrame, least: int = 3) -> DataFrame:
    """query, top, crowded: the most passages of one query's results (query, source) that one source has."""
    per = ranked.groupBy("query", "source").agg(F.count("*").alias("n"))
    return per.groupBy("query").agg(F.max("n").alias("top")).withColumn("crowded", F.col("top") >= least)


def confidence_signals(sources: DataFrame, weak: float = 0.3, span: float = 0.05, cluster_most: float = 0.7, few: int = 2) -> DataFrame:
    """answer, weak, clustered, few_sources from the retrieved sources (answer, source, score) of each answer.

    Weak: no score reaches ``weak``. Clustered: the three best lie within ``span`` and under
    ``cluster_most``. Answers without any score are weak and not clustered.
    """
    best = F.slice(F.reverse(F.array_sort(F.collect_list("score"))), 1, 3).alias("best")
    got = sources.groupBy("answer").agg(best, F.count_distinct("source").alias("n"))
    top, low = F.try_element_at("best", F.lit(1)), F.try_element_at("best", F.lit(3))
    return got.select("answer", (F.coalesce(top, F.lit(0.0)) < weak).alias("weak"), F.coalesce((top - low < span) & (top < cluster_most), F.lit(False)).alias("clustered"), (F.col("n") <= few).alias("few_sources"))
