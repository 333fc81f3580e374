"""Schema changes: readers of old and new versions, defaults, rebuilding, what breaks off."""

from __future__ import annotations

import pytest
from pyspark.sql.types import StructType

from lectern.operators import versions


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_versions(spark, tmp_path, monkeypatch):
    where = str(tmp_path)
    with pytest.raises(ValueError):
        versions.read(spark, where)
    first = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "id long, name string")
    assert versions.create(first, where) == 1 and versions.create(first, where) == 1
    wanted = [("kind", "string", "'concept'"), ("n", "int", None), ("name", "string", "'never'")]
    assert versions.add_columns(spark, where, wanted) == ["kind", "n"] and versions.add_columns(spark, where, wanted) == []
    assert versions.read(spark, where).dtypes == [("id", "bigint"), ("name", "string"), ("kind", "string"), ("n", "int")]
    old_reader = versions.read(spark, where, 1)
    assert versions.append(spark.createDataFrame([(3, None, 7, "gone")], "id int, kind string, n long, unknown string"), where) == 3
    assert rows(versions.read(spark, where).fillna({"name": "-", "n": 0, "kind": "-"})) == [(1, "a", "concept", 0), (2, "-", "concept", 0), (2, "-", "concept", 0), (3, "-", "-", 7)]

    before = versions.state(spark, where)
    monkeypatch.setattr(versions, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("broken off")))
    with pytest.raises(RuntimeError):
        versions.rebuild(spark, where, StructType.fromDDL("id long"))
    monkeypatch.undo()
    assert versions.state(spark, where) == before

    target = spark.createDataFrame([(1,), (3,), (3,), (9,)], "id long")
    shape = StructType.fromDDL("id int, kind string, fresh double")
    assert versions.rebuild(spark, where, shape, keep=None, references=("id", target)) == 2
    assert versions.read(spark, where).dtypes == [("id", "int"), ("kind", "string"), ("fresh", "double")]
    assert {r.id for r in versions.read(spark, where).collect()} == {1, 3}
    assert len(rows(old_reader.fillna("-"))) == 3 and versions.read(spark, where, 3).count() == 4
