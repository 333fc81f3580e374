"""Runs of the stateful ingest: new, changed, touched, removed and unreadable files, restarts, repeated batches."""

from __future__ import annotations

import hashlib
import os

from lectern.operators import store
from lectern.streaming import corpus


def write(path, text, seconds):
    path.write_text(text)
    os.utime(path, (1_700_000_000 + seconds, 1_700_000_000 + seconds))


def state(spark, where):
    rows = {r.path.rsplit("/", 1)[-1]: r.doc_hash for r in corpus.registry(spark, where).collect()}
    docs = {r.doc for r in store.read(spark, f"{where}/index", "docs").collect()}
    assert docs == {int(h[:15], 16) for h in rows.values() if h}
    return rows


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def test_runs(spark, tmp_path):
    root, where = tmp_path / "files", str(tmp_path / "state")
    root.mkdir()
    write(root / "a.txt", "alpha text", 0)
    write(root / "b.md", "beta text", 0)
    write(root / "same.txt", "alpha text", 0)
    write(root / "empty.txt", "", 0)
    write(root / "bad.docx", "no archive", 0)
    write(root / "other.bin", "not named", 0)
    assert corpus.ingest(spark, str(root), where, 1) == {"added": 4, "error": 1}
    want = {"a.txt": digest("alpha text"), "b.md": digest("beta text"), "same.txt": digest("alpha text"), "bad.docx": None}
    assert state(spark, where) == want

    assert corpus.ingest(spark, str(root), where, 2) == {"error": 0}  # nothing has changed; each run is a restart
    write(root / "b.md", "beta anew", 60)
    write(root / "same.txt", "alpha text", 60)  # touched only
    os.remove(root / "a.txt")
    write(root / "c.txt", "gamma", 0)
    assert corpus.ingest(spark, str(root), where, 3) == {"added": 1, "changed": 2, "removed": 1, "error": 0}
    want = {"b.md": digest("beta anew"), "same.txt": digest("alpha text"), "bad.docx": None, "c.txt": digest("gamma")}
    assert state(spark, where) == want  # the removed file's content stays, as another has it

    rows = corpus.registry_rows(spark, where)
    last = rows.filter("action = 'changed'").agg({"batch": "max"}).first()[0]
    again = rows.filter(f"batch = {last}").select("path", "action", "modified", "size", "run")
    again = spark.createDataFrame(again.collect(), again.schema)
    corpus.take(again, last, str(root), where)  # a batch that is repeated changes nothing
    assert state(spark, where) == want
    # one that broke off behind the registry: the old content is still in the index
    stale = spark.createDataFrame([(int(digest("beta text")[:15], 16), "beta text")], "doc_id long, text string")
    store.fill(stale, f"{where}/index")
    corpus.take(again, last, str(root), where)
    assert state(spark, where) == want
    for name in ("b.md", "same.txt", "empty.txt", "bad.docx", "c.txt", "other.bin"):
        os.remove(root / name)
    assert corpus.ingest(spark, str(root), where, 4) == {"removed": 4, "error": 0}
    assert state(spark, where) == {}
    write(root / "a.txt", "alpha text", 0)
    assert corpus.ingest(spark, str(root), where, 5) == {"added": 1, "error": 0}
    assert state(spark, where) == {"a.txt": digest("alpha text")}
