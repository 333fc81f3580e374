"""Packing of lengths that fit nowhere, and of rows repeated in full: no shard takes them all."""

from __future__ import annotations

from collections import Counter

import pytest

from lectern.llm import packing


@pytest.mark.parametrize("hot", [700, 900])
def test_no_shard_takes_a_hot_length(spark, monkeypatch, hot):
    monkeypatch.setattr(packing, "SHARD_PIECES", 100)
    rows = [(k, 0, 0, hot if k % 3 else 1 + k * 37 % 1000, k) for k in range(3000)]
    rows += [(None, 0, 0, hot, 7)] * 1000
    got = packing.pack(spark.createDataFrame(rows, packing.PIECE)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == Counter(rows)
    filled = Counter()
    for r in got:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 1024
    shards = Counter(r.sequence_id >> 24 for r in got if r.sequence_id >= 0)
    assert max(shards.values()) <= 200
