"""Snapshots."""

from __future__ import annotations

import pytest

from srcatlas.extract.run import build
from srcatlas.sources.store import SnapshotStore


def files(spark, *rows):
    return build(spark.createDataFrame([(p, f, bytearray(c.encode())) for p, f, c in rows], "project string, path string, content binary"))


def test_snapshots(spark, tmp_path):
    store = SnapshotStore(spark, f"{tmp_path}/store")
    assert store.read().files.count() == 0
    first = store.write(files(spark, ("", "a.py", "def one(): pass"), ("p", "b.py", "def two(): go()"), ("q/r", "c.py", "def three(): pass")))
    names = lambda ix: sorted((r.project, r.name, r.visibility_level) for r in ix.symbols.collect())
    assert names(store.read()) == [("", "one", 1), ("p", "two", 1), ("q/r", "three", 1)]
    store.upsert(files(spark, ("p", "b.py", "def zwei(): pass"), ("p", "d.py", "def _four(): pass")))
    assert names(store.read()) == [("", "one", 1), ("p", "_four", 2), ("p", "zwei", 1), ("q/r", "three", 1)]
    assert store.read().refs.count() == 0
    store.delete_project("q/r")
    assert {r[0] for r in names(store.read())} == {"", "p"}
    assert names(store.read(first))[1] == ("p", "two", 1) and store.versions() == [1, 2, 3]
    plan = store.read().symbols.filter("project = 'p'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(project" in plan or "PartitionFilters: [" in plan


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from srcatlas.sources.store import shared_folder

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(SimpleNamespace(sparkContext=context, conf={}))
