"""A killed stream goes on where it was and ends like an undisturbed one."""

from __future__ import annotations

import pytest

from corvane.sources.corpus import keep_identity
from corvane.streaming.ingest import TableSink, start

SCHEMA = "doc_id string, source_type string, title string, content string"


def test_restart_after_a_failure_converges(spark, tmp_path):
    def more(n, ids):
        spark.createDataFrame([(i, "jira", "t", f"text {i}\ncomments:\nAva Chen: hi") for i in ids], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    class Failing(TableSink):
        fail = True

        def send(self, items, batch):
            super().send(items, batch)
            if self.fail:
                raise RuntimeError("lost after the send, before the commit")

    more(0, ["d1", "d2"])
    sink, where = Failing(str(tmp_path / "items")), str(tmp_path / "state")
    docs = lambda: spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="lost after the send"):
        start(docs(), sink, where).awaitTermination()
    sink.fail = False
    more(1, ["d3", "d1"])
    for _ in range(2):
        start(docs(), sink, where).awaitTermination()
    got = sorted(r.id for r in sink.current(spark).collect())
    assert got == sorted(f"d{i}{s}" for i in (1, 2, 3) for s in ("", "_c00"))


def test_identity_guard(spark, tmp_path):
    keep_identity(spark, str(tmp_path), {"corpus": "a", "limit": 1})
    keep_identity(spark, str(tmp_path), {"corpus": "a", "limit": 1})
    with pytest.raises(ValueError, match="limit was 1, now 2"):
        keep_identity(spark, str(tmp_path), {"corpus": "a", "limit": 2})
