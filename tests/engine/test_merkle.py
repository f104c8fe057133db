"""Trees of hashes: updates by parts equal one build, and comparisons read the changed buckets alone."""

from __future__ import annotations

import pytest

from corvane.operators.merkle import Tree, changes, differing
from corvane.sources import manifest
from corvane.streaming.table import KeyedTable

SCHEMA = "doc_id string, source_type string, title string, content string"


def docs(spark, ids, text="text"):
    return spark.createDataFrame([(f"d{i}", "s", None, f"{text} {i}") for i in ids], SCHEMA)


def test_updates_equal_one_build_and_changes_are_told(spark, tmp_path, monkeypatch):
    a, b = Tree(str(tmp_path / "a")), Tree(str(tmp_path / "b"))
    a.update(docs(spark, range(300)))
    for part in (range(0, 100), range(100, 299), range(299, 310)):
        b.update(docs(spark, part))
    b.update(docs(spark, [5, 6], "wrong"))
    b.update(docs(spark, [5, 6]), removed=spark.createDataFrame([(f"d{i}",) for i in range(300, 310)], "doc_id string"))
    assert a.root_hash(spark) == b.root_hash(spark) and changes(spark, a, b).count() == 0 and differing(spark, a, b) == set()
    b.update(docs(spark, [7, 400], "other"), removed=spark.createDataFrame([("d9",), ("d1000",)], "doc_id string"))
    asked, real = [], KeyedTable.read
    monkeypatch.setattr(KeyedTable, "read", lambda self, s, only=None: asked.append(only) or real(self, s, only))
    got = {tuple(r) for r in changes(spark, a, b).collect()}
    assert got == {("d7", "changed"), ("d400", "appeared"), ("d9", "vanished")}
    assert [len(x) for x in asked if x is not None] == [len(differing(spark, a, b))] * 2 and len(differing(spark, a, b)) <= 3  # of 256 buckets


def test_an_update_that_ended_between_leaves_and_nodes(spark, tmp_path, monkeypatch):
    a, b = Tree(str(tmp_path / "a"), 1), Tree(str(tmp_path / "b"), 1)
    a.update(docs(spark, range(40)))
    b.update(docs(spark, range(30)))
    real = KeyedTable.upsert
    monkeypatch.setattr(KeyedTable, "upsert", lambda self, *x, **y: (_ for _ in ()).throw(RuntimeError("lost")) if self.key == "node" else real(self, *x, **y))
    with pytest.raises(RuntimeError, match="lost"):
        b.update(docs(spark, range(30, 35)))
    monkeypatch.setattr(KeyedTable, "upsert", real)
    with pytest.raises(ValueError, match="has not ended"):
        changes(spark, a, b)
    b.update(docs(spark, range(35, 40)))
    assert changes(spark, a, b).count() == 0 and a.root_hash(spark) == b.root_hash(spark)
    assert manifest.latest(spark, b.nodes.root)[1]["batch"] == manifest.latest(spark, b.leaves.root)[0]
