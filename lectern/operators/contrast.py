"""The terms of highest contrast with a reference, without counting all terms.

A term stands no more often than any of its words, and its weirdness is that of its most common word. So its
score is at most what each of its words would have by itself. Words are counted first. Then only terms of
words that reach a bar are counted, and the bar is lowered until the k best terms stand at it or above:
every other term has a word below the bar, and so a lower score than these.

Whether C-value lets a term pass hangs on the number of different terms that contain it. The most that one
batch of documents has of them is a bound from below, the sum over batches one from above. Only where these
leave it open are the terms that contain it sent and counted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators import grams, keywords, nesting
from lectern.operators.scratch import materialize

#: Words that set the first bar, for each of the k terms; as many times more if those did not suffice.
FIRST_WORDS, MORE = 8, 16
#: So many words over the bar, or terms left open, go to every task; with more, all terms are counted (``keywords.c_values``).
MOST_WORDS = 1 << 16


def by_batches(docs: DataFrame, text_col: str, batch: Callable[[np.ndarray, np.ndarray, np.ndarray], dict | None], schema: str) -> DataFrame:
    """What ``batch`` makes of the lengths, codes and words of so many documents at a time; worked on where they are read."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for _, lists in grams.listed(b.column(0), nesting.BATCH_TOKENS):
                codes, words = grams.numbered(lists)
                if (columns := batch(pc.list_value_length(lists).to_numpy(), codes, words)) is not None:
                    yield pa.RecordBatch.from_pydict(columns)

    return docs.select(grams.folded(text_col).alias("w")).mapInArrow(run, schema)


def word_totals(docs: DataFrame, stopwords: Sequence[str], text_col: str = "text") -> DataFrame:
    """token, n: how often each word stands that a term may hold."""

    def count(lengths: np.ndarray, codes: np.ndarray, words: np.ndarray) -> dict:
        fine = grams.fine_words(words, stopwords)
        return {"token": pa.array(words[fine], pa.string()), "n": pa.array(np.bincount(codes, minlength=len(words))[fine])}

    return by_batches(docs, text_col, count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def within(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each different part of each of the terms ``found``, and the place of the term that holds it."""
    two, three = np.flatnonzero(found[:, 1] >= 0), np.flatnonzero(found[:, 2] >= 0)
    x, y, z = found[two].T
    single = [(x, two), (y[y != x], two[y != x])]
    last = (z >= 0) & (z != x) & (z != y)
    single.append((z[last], two[last]))
    parts = [*(nesting.alone(word) for word, _ in single), nesting.alone(found[three, 0], found[three, 1]), nesting.alone(found[three, 1], found[three, 2])]
    return np.concatenate(parts), np.concatenate([*(at for _, at in single), three, three])


def touching(lengths: np.ndarray, codes: np.ndarray, words: np.ndarray, asked: frozenset[str], stopwords: Sequence[str], min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """The different terms with a word of ``asked``, their frequency, and of each number of a word, -1 last, whether it is asked for."""
    known = np.array([*(w in asked for w in words), False], bool)
    if not known.any():
        return None
    _, found = grams.placed(lengths, codes, words, stopwords, nesting.WORDS, min_chars)
    found, freq = nesting.summed(len(words), found[known[found].any(axis=1)])
    return found, freq[:, 0], known


def texts_of(words: np.ndarray, found: np.ndarray) -> pa.Array:
    return grams.Terms(np.zeros(0), found, np.zeros(0), words).every_text()


def term_bounds(docs: DataFrame, asked: frozenset[str], stopwords: Sequence[str], text_col: str, min_chars: int) -> DataFrame:
    """term, words, freq, total, least, most of the terms of asked words alone: the frequencies of the terms that contain it, summed up, and bounds of the number of these."""

    def count(lengths: np.ndarray, codes: np.ndarray, words: np.ndarray) -> dict | None:
        if (near := touching(lengths, codes, words, asked, stopwords, min_chars)) is None:
            return None
        found, freq, known = near
        part, at = within(found)
        own = np.stack([freq, np.zeros_like(freq), np.zeros_like(freq)], axis=1)
        every, counts = np.concatenate([found, part]), np.concatenate([own, nesting.beside(freq[at])])
        inside = (known[every] | (every < 0)).all(axis=1)
        every, counts = nesting.summed(len(words), every[inside], counts[inside])
        term = counts[:, 0] > 0
        every, (freq, n, total) = every[term], counts[term].T
        return {"term": texts_of(words, every), "words": pa.array((every >= 0).sum(axis=1).astype(np.int32)), "freq": pa.array(freq), "n": pa.array(n), "total": pa.array(total)}

    found = by_batches(docs, text_col, count, "term string, words int, freq long, n long, total long")
    sums = [F.sum("freq").alias("freq"), F.sum("total").alias("total"), F.max("n").alias("least"), F.sum("n").alias("most")]
    return found.groupBy("term", "words").agg(*sums)


def holders(docs: DataFrame, terms: frozenset[str], stopwords: Sequence[str], text_col: str, min_chars: int) -> DataFrame:
    """term, n: how many different terms contain each of ``terms``; those without any are left out."""
    asked = frozenset(w for t in terms for w in t.split(" "))

    def pairs(lengths: np.ndarray, codes: np.ndarray, words: np.ndarray) -> dict | None:
        if (near := touching(lengths, codes, words, asked, stopwords, min_chars)) is None:
            return None
        found, _, known = near
        part, at = within(found)
        inside = (known[part] | (part < 0)).all(axis=1)
        part, at = part[inside], at[inside]
        own = texts_of(words, part)
        named = np.array([t in terms for t in own.to_pylist()], bool)
        return {"term": own.filter(pa.array(named)), "holder": texts_of(words, found[at[named]])}

    return by_batches(docs, text_col, pairs, "term string, holder string").distinct().groupBy("term").agg(F.count("*").alias("n"))


def c_value_of(n: str) -> Column:
    """The C-value of a term that ``n`` different terms contain; the larger ``n``, the higher, to the last digit."""
    mean = F.when(F.col(n) > 0, F.col("total") / F.col(n)).otherwise(F.lit(0.0))
    return F.round(F.log2(F.col("words") + 1) * (F.col("freq") - mean), 6)


def strongest(docs: DataFrame, reference: DataFrame, stopwords: Sequence[str], k: int = keywords.TOP_K, ceiling: float = 8.0, min_cvalue: float = 0.0, text_col: str = "text", min_chars: int = keywords.MIN_CHARS) -> DataFrame:
    """What ``keywords.contrastive`` gives for ``c_values`` of ``docs``; each token stands in ``reference`` once."""
    reference = materialize(reference.select("token", "zipf"), "reference")
    rare = F.greatest(F.lit(0.0), F.lit(ceiling) - F.coalesce("zipf", F.lit(0.0)))
    reach = F.round((1 + F.log("n")) * rare, 6).alias("reach")
    ranked = word_totals(docs, stopwords, text_col).join(reference, "token", "left").select("token", "zipf", reach)
    ranked = materialize(ranked.filter("reach > 0"), "words")
    first, bar = FIRST_WORDS * k, None
    while True:
        last = bar is not None
        if not last:
            n, bar = ranked.orderBy(F.desc("reach")).limit(first).agg(F.count("*"), F.min("reach")).first()
            bar, last = (bar, False) if n == first else (0.0, True)
        chosen = ranked.filter(F.col("reach") >= bar)
        asked = frozenset(r[0] for r in chosen.select("token").limit(MOST_WORDS + 1).collect())
        found = best(docs, asked, chosen, stopwords, k, ceiling, min_cvalue, text_col, min_chars) if len(asked) <= MOST_WORDS else None
        if found is None:
            return keywords.contrastive(keywords.c_values(docs, stopwords, text_col=text_col, min_chars=min_chars), reference, k, ceiling, min_cvalue)
        scores = [r[0] for r in found.select("score").collect()]
        if last or len(scores) == k and min(scores) >= bar:
            return found
        first, bar = first * MORE, min(scores) if len(scores) == k else None


def best(docs: DataFrame, asked: frozenset[str], reference: DataFrame, stopwords: Sequence[str], k: int, ceiling: float, min_cvalue: float, text_col: str, min_chars: int) -> DataFrame | None:
    """term, score of the ``k`` best terms of asked words; None where more than MOST_WORDS are left open."""
    bounds = materialize(term_bounds(docs, asked, stopwords, text_col, min_chars), "bounds")
    bounds = bounds.withColumn("low", c_value_of("least")).withColumn("high", c_value_of("most"))
    sure = bounds.filter(F.col("low") > min_cvalue)
    ahead = keywords.first_terms(keywords.contrasts(sure, reference, ceiling), k)
    scores = [r[0] for r in ahead.select("score").collect()]
    unsure = bounds.filter((F.col("low") <= min_cvalue) & (F.col("high") > min_cvalue))
    rivals = keywords.contrasts(unsure, reference, ceiling).filter(F.col("score") >= (min(scores) if len(scores) == k else 0.0))
    names = frozenset(r[0] for r in rivals.select("term").limit(MOST_WORDS + 1).collect())
    if len(names) > MOST_WORDS:
        return None
    if names:
        counted = materialize(holders(docs, names, stopwords, text_col, min_chars), "holders")
        passed = unsure.join(F.broadcast(counted), "term").filter(c_value_of("n") > min_cvalue)
        sure = sure.unionByName(passed.drop("n"))
        ahead = keywords.first_terms(keywords.contrasts(sure, reference, ceiling), k)
    return materialize(ahead, "strongest").orderBy(F.desc("score"), "term").limit(k)
