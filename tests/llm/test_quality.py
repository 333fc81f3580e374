"""The quality classifier on long labelled texts."""

from __future__ import annotations

import numpy as np

from lectern.llm import quality


def test_labelled_text_of_a_megabyte(spark):
    ids = [k for k in range(40) if not spark.range(k, k + 1).select(quality.held_out("id")).first()[0]][:8]
    prose = "a plain line of words that goes on in the same way as before "
    rows = [(i, (prose if k % 2 else "X9 ## $$ 77 !! ") * (20 + k), k % 2) for k, i in enumerate(ids)]
    rows[1] = (rows[1][0], prose * 17_000, 1)  # over 1 MB
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    counts = quality.terms([rows[1][1].encode()])
    assert counts.max() > np.finfo(np.float16).max
    model = quality.fit(docs, labels)
    assert np.isfinite(model.vectors).all() and np.isfinite(model.axes).all()
    assert abs(model.vectors[sorted(ids).index(rows[1][0])] - model.project(counts)[0]).max() < 1e-4
    got = {r.doc_id: r.score for r in quality.score(docs, model, neighbours=3).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, _, y in rows)
