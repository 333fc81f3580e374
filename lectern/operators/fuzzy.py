"""Titles that are nearly the same: candidates by bigrams that lose none, verified by the ratio of matching blocks.

The ratio of two texts is twice the characters M of their matching blocks over both lengths T. Between
two blocks stands at least one unmatched character, so there are at most T - 2 M + 1 blocks, and the
texts share at least M - (T - 2 M + 1) bigrams, counted with repeats. At a ratio of r or more that is
(1.5 r - 1) T - 1, which is above 0 for the lengths that titles have; and the shorter length is at least
r / (2 - r) of the longer. A title is therefore indexed only under as many of its rarest bigrams
as it cannot spare; pairs that meet there are held against both bounds, and only then compared.

Null and empty titles match nothing. Equal titles are compared once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.scratch import join_sized, materialize

#: A pair is the same paper from this ratio on.
RATIO = 0.8
#: So many different bigrams, with their repeats, are broadcast at most; texts of letters, digits and spaces have a few thousand.
BROADCAST_GRAMS = 1 << 18
#: Titles shorter than this may share no bigram though they are alike; they are compared with all titles of the lengths they allow.
SHORTEST = 12
PAIR_SCHEMA = "a string, b string, ratio double"


def in_grams(titles: DataFrame) -> DataFrame:
    """x, title, n, held: a number for each title, its length and its bigrams, each with the number of its repeat: a multiset as a set."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts, held = batch.column(1).to_pylist(), []
            for text in texts:
                seen: Counter[str] = Counter()
                own = []
                for pair in zip(text, text[1:], strict=False):
                    gram = "".join(pair)
                    own.append(f"{gram}{seen[gram]}")
                    seen[gram] += 1
                held.append(own)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(len, texts), pa.int32()), pa.array(held, pa.list_(pa.string()))], names=["x", "title", "n", "held"])

    numbered = titles.select(F.monotonically_increasing_id().alias("x"), "title")
    return materialize(numbered.mapInArrow(run, "x long, title string, n int, held array<string>"), "grams")


def shared(total: Column, ratio: float) -> Column:
    """The bigrams that two texts of ``total`` characters share at least; in whole thousandths, so that no rounding loses one."""
    return F.greatest(F.lit(1), F.ceil(((round(1500 * ratio) - 1000) * total - 1000) / 1000)).cast("int")


def shortest_partner(n: Column, ratio: float) -> Column:
    return F.ceil(n * round(1000 * ratio) / (2000 - round(1000 * ratio))).cast("int")


def indexed(rows: DataFrame, df: DataFrame, ratio: float) -> DataFrame:
    """x, n, gram: a row for each gram that a title is indexed under, the rarest first."""
    small = df.count() <= BROADCAST_GRAMS
    each = rows.select("x", "n", F.explode("held").alias("gram")).join(F.broadcast(df) if small else df, "gram", "left")
    ordered = each.groupBy("x", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram"))).alias("g"))
    spare = shared(F.col("n") + shortest_partner(F.col("n"), ratio), ratio)
    return ordered.select("x", "n", F.explode(F.slice("g", F.lit(1), F.greatest(F.lit(1), F.size("g") - spare + 1))).alias("e")).select("x", "n", "e.gram")


def verified(pairs: DataFrame, ratio: float) -> DataFrame:
    """PAIR_SCHEMA of the pairs (a, b) whose ratio is ``ratio`` or more."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = []
            matcher = SequenceMatcher()
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                matcher.set_seqs(a, b)
                if matcher.quick_ratio() >= ratio and (r := matcher.ratio()) >= ratio:
                    out.append((a, b, r))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.float64()))], names=["a", "b", "ratio"])

    return pairs.select("a", "b").mapInArrow(run, PAIR_SCHEMA)


def alike(left: DataFrame, right: DataFrame, ratio: float = RATIO) -> DataFrame:
    """PAIR_SCHEMA: every a of ``left`` and b of ``right`` (title, normalised) whose ratio is ``ratio`` or more; none is lost."""
    if not 0.7 <= ratio <= 1:
        raise ValueError("candidates are found for ratios from 0.7 to 1")
    a, b = (materialize(t.select("title").filter("title <> ''").distinct(), "titles") for t in (left, right))
    long_a, long_b = (in_grams(t.filter(F.length("title") >= SHORTEST)) for t in (a, b))
    df = materialize(long_b.select(F.explode("held").alias("gram")).groupBy("gram").agg(F.count("*").alias("df")), "frequencies")
    left, right = indexed(long_a, df, ratio), indexed(long_b, df, ratio).select(F.col("x").alias("y"), F.col("n").alias("m"), "gram")
    near = (F.col("m") >= shortest_partner(F.col("n"), ratio)) & (F.col("n") >= shortest_partner(F.col("m"), ratio))
    met = left.join(right, "gram").filter(near).groupBy("x", "y").agg(F.count("*").alias("_met"))
    both = met.join(long_a, "x").join(long_b.select(F.col("x").alias("y"), F.col("title").alias("b"), F.col("n").alias("m"), F.col("held").alias("kept")), "y")
    enough = F.size(F.array_intersect("held", "kept")) >= shared(F.col("n") + F.col("m"), ratio)
    pairs = both.filter(enough).select(F.col("title").alias("a"), "b")
    out = verified(pairs, ratio)
    # short titles: by length, of which there are few
    for x, y, flip in ((a.filter(F.length("title") < SHORTEST), b, False), (b.filter(F.length("title") < SHORTEST), long_a.select("title"), True)):
        lengths = x.select("title", F.explode(F.sequence(shortest_partner(F.length("title"), ratio), F.floor(F.length("title") * (2000 - round(1000 * ratio)) / round(1000 * ratio)).cast("int"))).alias("n"))
        both = lengths.join(y.select(F.col("title").alias("other"), F.length("title").alias("n")), "n")
        sides = ("other", "title") if flip else ("title", "other")
        out = out.unionByName(verified(both.select(F.col(sides[0]).alias("a"), F.col(sides[1]).alias("b")), ratio))
    return out


def best_match(titles: DataFrame, library: DataFrame, ratio: float = RATIO) -> DataFrame:
    """title, target, ratio: for each normalised title of ``titles`` (title) the document of ``library`` (title, doc_id) with the highest ratio; the smallest of equal ones."""
    known = library.filter("title <> ''").groupBy("title").agg(F.min("doc_id").alias("target"))
    found = materialize(alike(titles, known, ratio), "alike")
    sized = materialize(found.groupBy(F.col("b").alias("title")).agg(F.count("*").alias("_n")).join(known, "title").withColumnRenamed("title", "b"), "targets")
    met = join_sized(found, sized, ["b"], "_n")
    return met.groupBy(F.col("a").alias("title")).agg(F.min(F.struct((-F.col("ratio")).alias("loss"), "target")).alias("best")).select("title", "best.target", (-F.col("best.loss")).alias("ratio"))
