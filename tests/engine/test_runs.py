from __future__ import annotations

import json

import pytest

from corvane.operators import context, items, judging, retrieval
from corvane.plans import answers, cli
from corvane.plans.run import Judge, Lock, RunConfig, manifest_rows, record_stage
from corvane.sources import corpus as sources
from corvane.streaming import ingest

from .test_operators import ROWS


def test_config_and_manifest(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"retrieval": {"alpha": 0.7}, "workers": 2}))
    own = RunConfig.load(str(tmp_path / "c.json"))
    assert own.fingerprint() == RunConfig(retrieval=own.retrieval, judge=Judge(shards=1)).fingerprint() != RunConfig().fingerprint()
    (tmp_path / "run").mkdir()
    (tmp_path / "run" / "a").write_text("1")
    record_stage(spark, str(tmp_path / "m"), "generate", own, str(tmp_path / "run"))
    assert manifest_rows(spark, str(tmp_path / "m")).count() == 1


def test_lock(tmp_path):
    with Lock(str(tmp_path / "l")):
        with pytest.raises(RuntimeError, match="held"):
            Lock(str(tmp_path / "l")).__enter__()
        with Lock(str(tmp_path / "l"), stale=-1):
            pass
        (tmp_path / "l").write_text("another")
    assert (tmp_path / "l").exists()


def test_commands(spark, tmp_path, capsys):
    names = [f.split()[0] for f in sources.RESULT.split(", ")]
    (tmp_path / "r.json").write_text(json.dumps({"questions": [dict(zip(names, r, strict=True)) for r in ROWS]}))
    (tmp_path / "q.jsonl").write_text("".join(json.dumps({"question_id": r[0], "expected_doc_ids": ["a"]}) + "\n" for r in ROWS))
    r, q = str(tmp_path / "r.json"), str(tmp_path / "q.jsonl")
    assert cli.main(["stats", "--results", r]) == 0
    assert cli.main(["report", "--results", r]) == 0 and "| all | 3 |" in capsys.readouterr().out
    assert cli.main(["compare", "--a", r, "--b", r, "--draws", "50"]) == 0
    assert cli.main(["verify", "--results", r, "--questions", q]) == 0
    assert cli.main(["verify", "--results", r, "--questions", q, "--strict"]) == 2
    (tmp_path / "few.jsonl").write_text(json.dumps({"question_id": "q1"}) + "\n")
    assert cli.main(["verify", "--results", r, "--questions", str(tmp_path / "few.jsonl")]) == 1
    assert cli.main(["inspect", "--id", "q1", "--questions", q]) == 0


def test_edges_and_dry_run(spark):
    docs = spark.createDataFrame([("s", "slack", "t", "Ann: a\n\nBob: b"), ("g", "gmail", "t", "From: a\n\nx\n\nFrom: b\n\ny")], "doc_id string, source_type string, title string, content string")
    got = {(r.src, r.dst, r.kind) for r in items.edges(items.typed_items(docs)).collect()}
    assert {("s_m0001", "s_m0000", "parent_id"), ("g_e01", "g_e00", "in_reply_to"), ("g_e00", "g", "thread_id")} <= got
    assert {(r.source_type, r.documents, r["items"], r.batches) for r in ingest.dry_run(docs, 10).collect()} == {("slack", 1, 2, 1), ("gmail", 1, 2, 1)}


def test_patience():
    waits = []

    class Sink:
        left = 2

        def send(self, items, batch):
            if self.left:
                self.left -= 1
                raise ingest.Busy("Retry in 3 seconds" if self.left else "busy")

    ingest.Patient(Sink(), sleep=waits.append).send(None, 0)
    assert waits == [3.0, 30.0]
    with pytest.raises(ingest.Busy):
        ingest.Patient(Sink(), tries=1).send(None, 0)
    told, calls = [], []

    def flaky(stage, question, text):
        calls.append(stage)
        if len(calls) < 3:
            raise TimeoutError
        return "x"

    assert answers.with_retries(flaky, sleep=told.append)("draft", "", "") == "x" and told == [1.0, 2.0]


def test_status_stream(spark, tmp_path):
    schema = "batch long, id string, status string, seq long"
    for rows in ([(1, "a", "pending", 1), (1, "b", "errored", 2)], [(1, "a", "completed", 3)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "log"))
    stream = ingest.latest_statuses(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "log")))
    stream.writeStream.outputMode("complete").format("memory").queryName("statuses").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert {(r.id, r.status) for r in spark.table("statuses").collect()} == {("a", "completed"), ("b", "errored")}


def test_judging_skips_complete_shards(spark):
    q = spark.createDataFrame([("q1", "x"), ("q2", "y")], "question_id string, gold_answer string")
    a = spark.createDataFrame([("q1", "x"), ("q2", "n")], "question_id string, answer string")
    plan = judging.shard_plan(q, 2)
    scorer = lambda r: {"answer_correct": r["answer"] == r["gold_answer"], "completeness_pct": 100.0 * (r["answer"] == r["gold_answer"])}
    got = judging.judge(a, q, plan, scorer)
    assert {(r.question_id, r.answer_correct) for r in got.collect()} == {("q1", True), ("q2", False)}
    done = judging.complete_shards(got.where("shard = 0"), plan)
    assert [r.question_id for r in judging.judge(a, q, plan, scorer, done).collect()] == ["q2"]


def test_replay(spark):
    import hashlib

    good = hashlib.sha256(b"text").hexdigest()
    checkpoint = spark.createDataFrame([("q1", "answered", good, ["a", "b"], ["a"]), ("q2", "retrieved", "0", None, ["c"]), ("q3", "error", good, None, None)], "question_id string, stage string, context_sha256 string, retrieved_doc_ids array<string>, context_docs array<string>")
    saved = spark.createDataFrame([("q1", "text", ["a"]), ("q2", "tampered", ["c"])], "question_id string, context string, context_docs array<string>")
    replay = context.replayed(checkpoint, saved)
    assert {(r.question_id, tuple(r.document_ids), r.rebuild) for r in replay.collect()} == {("q1", ("a", "b"), False), ("q2", ("c",), True)}
    rebuilt = spark.createDataFrame([("q2", "new")], "question_id string, context string")
    assert {(r.question_id, r.context, r.rebuilt_here) for r in context.finished(replay, rebuilt).collect()} == {("q1", "text", False), ("q2", "new", True)}


def test_search(spark):
    corpus = spark.createDataFrame([("a", "red fox"), ("b", "blue whale whale")], "doc_id string, content string")
    q = spark.createDataFrame([("q", "whale fox")], "question_id string, question string")
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "doc_id string, embedding array<float>")
    qv = spark.createDataFrame([("q", [1.0, 0.1])], "question_id string, vector array<float>")
    first = lambda df: df.where("rank = 1").first().doc_id
    assert first(retrieval.search(q, corpus)) == "b" and first(retrieval.search(q, corpus, query_by="vector", vectors=v, query_vectors=qv)) == "a"
    assert first(retrieval.search(q, corpus, query_by="hybrid", alpha=0.9, vectors=v, query_vectors=qv)) == "a"
    with pytest.raises(ValueError, match="vectors are needed"):
        retrieval.search(q, corpus, query_by="hybrid")


def test_generate_judge_and_audit(spark, tmp_path, capsys):
    import json
    import sys

    from corvane.plans import cli

    root = tmp_path / "sources" / "jira"
    root.mkdir(parents=True)
    for i, text in enumerate(("The red fox ran home. It rained", "A blue whale swims. It sings")):
        (root / f"{i}.json").write_text(json.dumps({"title_field_name": "t", "content_field_names": ["c"], "dataset_doc_uuid": f"x{i}", "t": "T", "c": text}))
    gold = {"expected_doc_ids": ["x0"], "gold_answer": "fox", "answer_facts": ["f"]}
    lines = [{"question_id": "q1", "question": "where did the red fox run", **gold}, {"question_id": "q2", "question": "what is a blue whale", **gold, "expected_doc_ids": ["x1"]}]
    one, both = tmp_path / "one.jsonl", tmp_path / "q.jsonl"
    one.write_text(json.dumps(lines[0]) + "\n")
    both.write_text("".join(json.dumps(x) + "\n" for x in lines))
    run = str(tmp_path / "run")
    go = lambda *a: cli.main([str(x) for x in a])
    assert go("generate", "--run", run, "--questions", one, "--checkout", tmp_path / "sources") == 0
    assert go("generate", "--run", run, "--questions", both, "--checkout", tmp_path / "sources") == 0  # only the second is new
    got = {r.question_id: (r.answer, r.document_ids[0]) for r in spark.read.json(f"{run}/answers").collect()}
    assert set(got) == {"q1", "q2"} and got["q2"][1] == "x1"
    assert go("generate", "--run", run, "--questions", one, "--checkout", tmp_path / "sources") == 1  # narrower
    (tmp_path / "scorers.py").write_text("def same(r):\n    return {'answer_correct': 'fox' in r['answer'], 'completeness_pct': 50.0}\n")
    sys.path.insert(0, str(tmp_path))
    import scorers

    from pyspark import cloudpickle as own

    own.register_pickle_by_value(scorers)
    for _ in range(2):
        assert go("judge", "--run", run, "--questions", both, "--answers", f"{run}/answers", "--scorer", "scorers:same", "--shards", 2) == 0
    assert spark.read.json(f"{run}/judged").count() == 2
    record = {"question_id": "q1", "before": gold, "after": {**gold, "valid_doc_ids": ["v"]}, "update_reasons": ["valid only"], "doc_set_changed": False, "gold_answer_changed": False}
    (tmp_path / "r.json").write_text(json.dumps({"questions": [{"question_id": q, "question_type": "t", "answer_correct": True, "completeness_pct": 50.0, "corrected": False} for q in ("q1", "q2")]}))
    for valid, code in ((["v"], 0), ([], 1)):
        record["after"]["valid_doc_ids"] = valid
        (tmp_path / "c.jsonl").write_text(json.dumps(record) + "\n")
        assert go("audit-corrections", "--results", tmp_path / "r.json", "--corrections", tmp_path / "c.jsonl", "--questions", both) == code
    assert go("doctor", "--path", both) == 0 and go("doctor", "--path", tmp_path / "nowhere") == 1
    assert "changes nothing" in capsys.readouterr().out


def test_polling_and_provision(spark):
    from corvane.streaming import ingest

    now, asked = [0.0], []

    def ask(ids):
        asked.append(list(ids))
        return {i: "completed" if now[0] >= 20 and i != "c" else "errored" if i == "b" else "queued" for i in ids}

    def sleep(seconds):
        now[0] += seconds

    got = ingest.settled(ask, ["a", "b", "c"], timeout=30, each=2, clock=lambda: now[0], sleep=sleep)
    assert got == {"a": "completed", "b": "errored", "c": "pending"}
    assert asked[:2] == [["a", "b"], ["c"]] and asked[2] == ["a", "c"]
    sent = spark.createDataFrame([("b1", "x"), ("b1", "y"), ("b2", "z")], "batch string, id string")
    told = ingest.poll(sent, lambda ids: {i: "errored" if i == "y" else "completed" for i in ids})
    assert {tuple(r) for r in told.collect()} == {("b1", "x", "completed"), ("b1", "y", "errored"), ("b2", "z", "completed")}
    assert ingest.provision(spark, "corvane_test") == []
    with pytest.raises(ValueError, match="no name"):
        ingest.provision(spark, "a; b")


def test_search_service(spark):
    assert "graph_context" not in retrieval.request("q", "c") and retrieval.request("q", "c", graph_context=True)["graph_context"]
    with pytest.raises(ValueError, match="no such search"):
        retrieval.request("q", "c", mode="slow")
    q = spark.createDataFrame([("q1", "fox"), ("q2", "empty")], "question_id string, question string")
    tried: dict = {}

    def ask(r):
        n = tried[r["query"]] = tried.get(r["query"], 0) + 1
        if n == 1:
            raise TimeoutError
        return [] if r["query"] == "empty" or n == 2 else [{"chunk_id": "d_c01", "content": "a", "score": 0.5}, {"chunk_id": "e"}]

    got = retrieval.search_service(q, ask, "c", attempts=3, sleep=lambda s: None)
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [("q1", 1, "d_c01", "a", 0.5), ("q1", 2, "e", None, None)]

    def down(r):
        raise ConnectionError("down")

    with pytest.raises(Exception, match="down"):
        retrieval.search_service(q, down, "c", attempts=2, sleep=lambda s: None).collect()
