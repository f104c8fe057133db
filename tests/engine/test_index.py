"""The stored index against searching the corpus anew, through upserts, removals and torn writes."""

from __future__ import annotations

import random

import pytest

from corvane.operators import index, retrieval
from corvane.sources import manifest

DOC = "doc_id string, content string"


def corpus(seed, ids):
    r = random.Random(seed)
    return {i: " ".join(r.choice(["the", "of", *(f"w{k}" for k in range(40))]) for _ in range(r.randrange(1, 60))) for i in ids}


def rows(df):
    return sorted((r.question_id, r.doc_id, r.score, r["rank"]) for r in df.collect())


def test_index_equals_the_corpus_after_each_change(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "BLOCK", 7)
    root, q = str(tmp_path / "i"), spark.createDataFrame([("q1", "the w1 w2 w2"), ("q2", "of w39 absent"), ("q3", "absent"), ("q4", "")], "question_id string, question string")
    frame = lambda d: spark.createDataFrame(list(d.items()), DOC)
    same = lambda now: rows(index.search(spark, root, q, 9)) == rows(retrieval.lexical(q, frame(now), 9))
    now = corpus(1, [f"d{i}" for i in range(60)]) | {"empty": "", "null": None}
    index.upsert(spark, root, frame(now))
    assert same(now)
    new = corpus(2, [f"d{i}" for i in range(50, 80)])
    index.upsert(spark, root, frame(new))
    now |= new
    assert same(now)
    index.remove(spark, root, spark.createDataFrame([("d3",), ("d55",), ("nowhere",)], "doc_id string"))
    now = {k: v for k, v in now.items() if k not in ("d3", "d55")}
    assert same(now)
    index.remove(spark, root, spark.createDataFrame([("d3",)], "doc_id string"))  # once more changes nothing
    again = corpus(3, ["d3", "d60", "d61"])
    index.upsert(spark, root, frame(again))
    now |= again
    assert same(now)
    many = index.postings(spark, root, spark.createDataFrame([("the",)], "term string"))
    assert many.count() == sum("the" in (v or "").split() for v in now.values())
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan or "bucket" in plan.split("PartitionFilters")[1][:60]
    # a write that ended before its manifest, and one that tore it, are not there
    monkeypatch.setattr(index.manifest, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        index.upsert(spark, root, frame(corpus(4, ["d1", "d2"])))
    monkeypatch.undo()
    version = manifest.following(spark, root)
    (tmp_path / "i" / "manifest" / f"{version:012d}").write_text('{"segments": [')
    assert same(now) and manifest.latest(spark, root)[0] == version - 1
    index.upsert(spark, root, frame(corpus(5, ["d7"])))
    assert same(now | corpus(5, ["d7"]))


def test_two_writers_conflict(spark, tmp_path):
    manifest.commit(spark, str(tmp_path), 1, {"a": 1})
    with pytest.raises(manifest.Conflict):
        manifest.commit(spark, str(tmp_path), 1, {"a": 2})
    assert manifest.latest(spark, str(tmp_path)) == (1, {"a": 1}) and manifest.following(spark, str(tmp_path)) == 2


def test_postings_are_not_written_before_they_are_packed(spark, tmp_path, monkeypatch):
    """Tables on the way to a segment have a row a document, not a row for each word of it."""
    sizes, kept = [], index.kept
    monkeypatch.setattr(index, "kept", lambda df, name: (out := kept(df, name), sizes.append(out.count()))[0])
    now = corpus(6, [f"d{i}" for i in range(50)])
    index.upsert(spark, str(tmp_path / "i"), spark.createDataFrame(list(now.items()), DOC))
    assert max(sizes) == len(now)
    words = spark.read.parquet(str(tmp_path / "i" / "postings" / "seg=1"))
    got = sorted((r.term, d, n) for r in words.collect() for d, n in zip(r.ids, r.tfs, strict=True))
    assert got == sorted((t, d, v.split().count(t)) for d, v in now.items() for t in set(v.split()))
