"""The keyed table through replays, crashes, removals and concurrent writers."""

from __future__ import annotations

import pytest

from corvane.sources import manifest
from corvane.streaming.ingest import start
from corvane.streaming.table import KeyedSink, KeyedTable

SCHEMA = "id string, n int, tags array<string>"


def rows(spark, ids, n):
    return spark.createDataFrame([(i, n, [i]) for i in ids], SCHEMA)


def state(spark, t):
    return {r.id: r.n for r in t.read(spark).collect()}


def test_upserts_replays_and_removals(spark, tmp_path):
    t = KeyedTable(str(tmp_path / "t"), buckets=8)
    with pytest.raises(ValueError, match="no table"):
        t.read(spark)
    t.upsert(rows(spark, [f"k{i}" for i in range(40)], 1), 0)
    before = t.read(spark)
    t.upsert(rows(spark, ["k3", "new", None], 2), 1)
    want = {f"k{i}": 1 for i in range(40)} | {"k3": 2, "new": 2}
    assert state(spark, t) == want
    v = manifest.latest(spark, t.root)[0]
    assert t.upsert(rows(spark, ["k3", "k9"], 7), 1) == v and t.upsert(rows(spark, ["k3"], 7), 0) == v and state(spark, t) == want  # both came before
    live = manifest.latest(spark, t.root)[1]["live"]
    assert len({x for x in live.values()}) == 2 and sum(x == v for x in live.values()) <= 2  # untouched buckets keep their files
    assert all("/v=" in f for f in t.read(spark).inputFiles()) and len(t.read(spark).inputFiles()) == len(live)
    assert {r.n for r in before.collect()} == {1}  # a reader keeps its version
    twice = spark.createDataFrame([("k5", 8, ["a"]), ("k5", 9, ["b"]), ("k6", 3, ["z"])], SCHEMA)
    t.upsert(twice, 2, order="n", removed=spark.createDataFrame([("k7",), ("k6",), ("nowhere",)], "id string"))
    want |= {"k5": 9, "k6": 3}
    del want["k7"]
    assert state(spark, t) == want
    t.upsert(rows(spark, [], 0), 3)
    assert state(spark, t) == want and manifest.latest(spark, t.root)[1]["batch"] == 3
    with pytest.raises(ValueError, match="columns differ"):
        t.upsert(spark.createDataFrame([("k1", 2)], "id string, n int"), 4)
    assert t.vacuum(spark) and state(spark, t) == want and not t.vacuum(spark)
    everything = t.read(spark).select("id")
    t.upsert(rows(spark, [], 0), 5, removed=everything)
    assert state(spark, t) == {}


def test_a_crash_before_the_commit_leaves_one_state(spark, tmp_path, monkeypatch):
    t = KeyedTable(str(tmp_path / "t"), buckets=4)
    t.upsert(rows(spark, ["a", "b"], 1), 0)
    real = manifest.commit
    monkeypatch.setattr(manifest, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        t.upsert(rows(spark, ["a", "c", "d"], 2), 1)
    assert state(spark, t) == {"a": 1, "b": 1}
    monkeypatch.setattr(manifest, "commit", real)
    t.upsert(rows(spark, ["a", "c"], 3), 1)  # other rows than the lost try wrote
    assert state(spark, t) == {"a": 3, "b": 1, "c": 3}

    def overtaken(spark_, root, version, content):
        real(spark_, root, version, content)
        real(spark_, root, version, content)

    monkeypatch.setattr(manifest, "commit", overtaken)
    with pytest.raises(manifest.Conflict):
        t.upsert(rows(spark, ["e"], 4), 2)


def test_stream_into_a_keyed_table(spark, tmp_path):
    schema = "doc_id string, source_type string, title string, content string"

    def more(rows_):
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    class Failing(KeyedSink):
        fail = True

        def send(self, items, batch):
            super().send(items, batch)
            if self.fail:
                raise RuntimeError("lost after the send")

    sink, where = Failing(str(tmp_path / "items"), 4), str(tmp_path / "state")
    docs = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    more([(f"d{i}", "jira", "t", f"text {i}\ncomments:\nAva Chen: hi") for i in (1, 2)])
    with pytest.raises(Exception, match="lost after the send"):
        start(docs(), sink, where).awaitTermination()
    version = manifest.latest(spark, sink.table.root)[0]
    sink.fail = False
    start(docs(), sink, where).awaitTermination()
    assert manifest.latest(spark, sink.table.root)[0] == version  # the batch was there
    more([("d1", "jira", "other title", "new text")])
    start(docs(), sink, where).awaitTermination()
    got = {r.id for r in sink.current(spark).collect()}
    assert got >= {"d1", "d2", "d2_c00"} and sink.current(spark).where("id = 'd1'").count() == 1


def test_scratch_folders_are_discarded(spark):
    import os

    from corvane.plans import workspace

    df = workspace.kept(spark.range(5).toDF("id"), "numbers")
    path = os.path.dirname(df.inputFiles()[0].removeprefix("file://"))
    assert df.count() == 5 and os.path.basename(path).startswith("numbers-")
    workspace.discard(spark, path)
    workspace.discard(spark, path)  # once more is no error
    assert not os.path.exists(path)
