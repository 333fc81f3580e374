"""Block-Max WAND against the score of every document, with small blocks and segments, and on odd rows."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lectern.llm import lexical_search as lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, segment long, term string, score int"


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items):
    docs = [(i, w) for i, t in rows if (w := terms(t))]
    n, length = len(docs), sum(len(w) for _, w in docs)
    df = Counter(t for _, w in docs for t in set(w))
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * k + 1))) for t, k in df.items()}
    out = Counter()
    for item, text in set(items):
        scored = []
        for i, w in docs:
            tf, m = Counter(w), 10 + 90 * len(w) * n // length
            score = sum(weight[t] * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m)) for t in set(terms(text)) if t in tf)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out.update((item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scored)[:10], 1))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(12)
    vocabulary = [f"t{k}" for k in range(300)] + ["É", "ñandú", "日本", "a1b2"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    rows = [(rng.randrange(10_000), " ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 80)))) for _ in range(900)]
    rows += [(20_000 + k, "T1 t2, t250! T251") for k in range(60)]  # many of equal score
    rows += [(None, "t1 t2 t250 t251"), (None, "t1 t2 t250 t251"), (None, None), (5, None), (6, ""), (7, " .,;\x00 "), (2**63 - 1, "t1 t2 t250 t251"), (-4, "t1 t2 t250 t251")]
    rows += [(30_000, "t7 " * 70_000), (30_001, "x" * 200_000)]
    rng.shuffle(rows)
    items = [(k, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 30)))) for k in range(25)]
    items += [(100, "t250 T251"), (100, "t250 T251"), (100, "t7"), (101, None), (102, ""), (103, "unknown"), (None, "t2"), (104, "x" * 200_000)]
    return rows, items


def got(spark, rows, items):
    docs = spark.createDataFrame([(*r, 1, "t", 2) for r in rows], SCHEMA)
    asked = spark.createDataFrame([(*i, 3) for i in items], "item_id long, text string, query int")
    return Counter(tuple(r) for r in lexical.ranked(docs, asked).collect())


def test_against_every_document(spark, corpus):
    assert got(spark, *corpus) == brute(*corpus)


def test_small_blocks_segments_and_query_blocks(spark, corpus, monkeypatch):
    rows, items = corpus
    prepared = lexical.query_terms(spark.createDataFrame(items, "item_id long, text string"))
    for name, value in (("SEGMENT_DOCS", 100), ("QUERY_BLOCK", 5)):
        monkeypatch.setattr(lexical, name, value)
    assert prepared[0].count() == len(set(items))
    assert got(spark, rows, items) == brute(rows, items)
    monkeypatch.setattr(lexical, "is_small", lambda _: False)  # all terms are indexed, the lists joined by shuffle
    assert got(spark, rows, items) == brute(rows, items)


def segment(rng, n, n_terms):
    built = lexical._Segment()
    for k in range(n):
        counts = {f"t{t}".encode(): rng.choice([1, 1, 2, 300, 70_000]) for t in range(n_terms) if rng.random() < 0.4 / (1 + t % 7)}
        if counts:
            built.add(k * 3, counts, rng.randrange(10, 500), 1)
    rows = [r for b in built.rows(4) for r in b.to_pylist()]
    return rows[0], rows[1:]


def test_blocks_are_compressed_and_skipped():
    rng = random.Random(3)
    head, lists = segment(rng, 5000, 12)
    norms, ids = np.array(head["norms"]), np.array(head["doc_ids"])
    held = [lexical._List(r | {"weight": 100 * (k + 1)}, norms) for k, r in enumerate(lists)]
    best = []
    lexical.search_segment(held, ids, np.zeros(len(ids), bool), best)
    opened, blocks = sum(int(x.open.sum()) for x in held), sum(len(x.open) for x in held)
    total = np.zeros(len(ids), np.int64)
    for x in held:
        x.decompress(np.arange(len(x.open)))
        total[x.docs] += x.scores
        assert (np.diff(x.docs) > 0).all()
        assert all((x.scores[b * lexical.BLOCK : (b + 1) * lexical.BLOCK].max() == m) for b, m in enumerate(x.maxima))
    want = sorted(zip(-total, ids, strict=True))[: lexical.TOP]
    assert sorted((-s, -i) for s, i, _ in best) == [(int(s), int(i)) for s, i in want]
    high = [(10**12, -1, True)] * lexical.TOP
    again = [lexical._List(r | {"weight": 1}, norms) for r in lists]
    lexical.search_segment(again, ids, np.zeros(len(ids), bool), high)
    assert not any(x.open.any() for x in again) and opened <= blocks
    assert sum(len(r["payload"]) for r in lists) <= 6 * sum(r["df"] for r in lists)  # counts of 70,000 take four bytes, distances two


def test_empty_tables(spark):
    assert not got(spark, [], [(1, "a")]) and not got(spark, [(1, "a")], []) and not got(spark, [(1, None)], [(1, "a")])
