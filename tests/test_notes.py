"""Topic notes: contents, what lacks, and that a second run writes only what has changed."""

from __future__ import annotations

from lectern.operators import notes


def frames(spark, clusters):
    docs = spark.createDataFrame([(d, f"h{d:03d}", None if d == 9 else f"Title {d}") for d in range(1, 20)] + [(50, None, "no hash")], "doc long, doc_hash string, title string")
    words = spark.createDataFrame([(1, "deep nets"), (2, "deep nets"), (3, "other"), (4, "zeta"), (5, "alpha")], "doc long, keyword string")
    edges = spark.createDataFrame([(1, 4), (4, 1), (1, 2), (3, 99), (None, 1)], "a long, b long")
    return spark.createDataFrame(clusters, "cluster string, doc long"), docs, words, edges


def test_notes_and_runs(spark, tmp_path):
    where = str(tmp_path / "notes")
    clusters = [("x", 1), ("x", 2), ("x", 3), ("x", 3), ("y", 4), ("y", 5), ("z", 9), (None, 6), ("x", 50), ("w", None)]
    made = {r.title: (r.topic, r.markdown) for r in notes.assemble(*frames(spark, clusters)).collect()}
    assert len(made) == 3 and {"Deep Nets", "Alpha"} < set(made)
    topic, text = made["Deep Nets"]
    other = made["Alpha"][0]
    assert text.startswith(f"---\ntopic_id: {topic}\n") and "n_docs: 3\ngaps: []" in text and text.count("- Title") == 3 and f"- [[{other}|Alpha]]" in text
    assert "gaps: [citation_thin]" in made["Alpha"][1] and "gaps: [citation_thin, single_source, no_links]" in next(t for n, (_, t) in made.items() if n not in ("Deep Nets", "Alpha"))

    assert notes.refresh(notes.assemble(*frames(spark, clusters)), where, 1) == {"added": 3}
    assert notes.refresh(notes.assemble(*frames(spark, clusters)), where, 2) == {}
    files = spark.read.option("recursiveFileLookup", "true").parquet(where).inputFiles()
    assert all("run_1" in f for f in files)
    more = [*clusters, ("y", 7)]  # y is another topic now, and x links to that
    assert notes.refresh(notes.assemble(*frames(spark, more)), where, 3) == {"added": 1, "changed": 1, "removed": 1}
    assert notes.refresh(notes.assemble(*frames(spark, more)), where, 3) == {"added": 1, "changed": 1, "removed": 1}  # the same run again
    now = {r.topic: r.digest for r in notes.current(spark, where).collect()}
    assert now == {r.topic: r.digest for r in notes.assemble(*frames(spark, more)).collect()} and len(now) == 3
    assert notes.refresh(notes.assemble(*frames(spark, [])), where, 4) == {"removed": 3} and notes.current(spark, where).count() == 0
