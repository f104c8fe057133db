from __future__ import annotations

import hashlib
import json
import random

import pytest

from corvane.operators import context, identity, judging, ledger, metrics, retrieval, validation
from corvane.plans import answers, report
from corvane.sources import corpus as sources


def plain_fold(sizes, budget):
    total, kept = 0, []
    for i, s in enumerate(sizes, 1):
        if total + s <= budget or not kept:
            kept.append(i)
            total += s + 9
    return kept


def test_budget_fold_equals_a_loop(spark):
    from pyspark.sql import functions as F

    r = random.Random(1)
    rows = [([r.choice([10, 100, 1000, 3000]) for _ in range(r.randrange(0, 12))],) for _ in range(60)] + [([1000, 1000, 1000, 100],)]
    docs = spark.createDataFrame(rows, "s array<int>").select("s", F.transform("s", lambda v, i: F.struct((i + 1).alias("rank"), v.cast("long").alias("size"))).alias("docs"))
    got = docs.select("s", context.budget_fold(F.col("docs"), 2300)["kept"].alias("kept")).collect()
    assert all(row.kept == plain_fold(row.s, 2300) for row in got)
    assert [row.kept for row in got if row.s == [1000, 1000, 1000, 100]] == [[1, 2, 4]]


def test_batch_fold_equals_a_loop(spark):
    from pyspark.sql import functions as F

    r = random.Random(2)
    rows = [([r.randrange(0, 9) for _ in range(r.randrange(0, 15))],) for _ in range(50)]
    for row in spark.createDataFrame(rows, "s array<int>").select("s", ledger.batch_fold(F.transform("s", lambda v: v.cast("long")), 10).alias("b")).collect():
        batch = n = 0
        want = []
        for s in row.s:
            want.append(batch)
            n += s
            if n >= 10:
                batch, n = batch + 1, 0
        assert row.b == want


def test_contexts_drop_whole_documents_and_fall_back(spark):
    corpus = spark.createDataFrame([(f"d{i}", "s", "t", "x" * 100) for i in range(4)], "doc_id string, source_type string, title string, content string")
    ranked = spark.createDataFrame([("q", 1, "d0"), ("q", 2, "gone"), ("q", 3, "d1"), ("q", 4, "d2")], "question_id string, doc_rank int, doc_id string")
    chunks = spark.createDataFrame([("q", 2, "gone_m0001", "b"), ("q", 1, "gone_m0000", "a")], "question_id string, rank int, chunk_id string, chunk_content string")
    questions = spark.createDataFrame([("q",), ("none",)], "question_id string")
    got = {r.question_id: r for r in context.build(context.hydrate(ranked, corpus, chunks), questions, 3, 330).collect()}
    assert got["none"].context == "(no context retrieved)" and got["none"].context_docs == []
    assert got["q"].context_docs == ["d0", "gone"] and got["q"].dropped_docs == ["d1"] and got["q"].chunk_fallback_docs == ["gone"]
    assert "a\n...\nb" in got["q"].context and got["q"].context_sha256 == hashlib.sha256(got["q"].context.encode()).hexdigest()


ROWS = [("q1", "a", True, 80.0, 100.0, 1, False, ""), ("q2", "a", False, 50.0, None, None, False, ""), ("q3", "b", True, 100.0, 0.0, 4, True, "")]


def results(spark, rows=ROWS):
    return spark.createDataFrame(rows, sources.RESULT)


def test_group_stats_and_report(spark):
    got = {r.grp: r for r in metrics.group_stats(results(spark)).collect()}
    assert got[None].is_total and got[None].n == 3 and got[None].combined == 60.0 and got["a"].recall == 100.0 and got["b"].invalid_extra == 4.0
    text = report.markdown("run", results(spark), leaderboard=[{"system": "x", "overall": 70.0}])
    assert "| all | 3 | 60.0 |" in text and "| 2 | run | 60.0 |" in text


def test_recall_is_set_based(spark):
    questions = spark.createDataFrame([("q1", ["a", "a", "b"]), ("q2", []), ("q3", ["z"])], "question_id string, expected_doc_ids array<string>")
    ranked = spark.createDataFrame([("q1", ["a", "c", "b"])], "question_id string, document_ids array<string>")
    got = {r.k: (r.recall_pct, r.invalid_extra, r.n) for r in metrics.recall_at(ranked, questions, (1, 3)).collect()}
    assert got == {1: (25.0, 0.0, 2), 3: (50.0, 0.5, 2)}
    assert metrics.full_coverage(ranked, questions, 3).first() == (1, 2)


def test_bootstrap(spark):
    a = results(spark)
    pairs = metrics.paired(a, results(spark, [(q, t, not ok, c, r, e, x, y) for q, t, ok, c, r, e, x, y in ROWS]))
    assert {r.flip: r.n for r in metrics.flips(pairs).collect()} == {"T->F": 2, "F->T": 1}
    assert {tuple(r) for r in metrics.flipped(pairs).collect()} == {("q1", "T->F"), ("q2", "F->T"), ("q3", "T->F")}
    assert metrics.summary(a, a.where("question_type = 'a'")).first() == (2, 40.0, 50.0, 65.0)
    with pytest.raises(Exception, match="no results"):
        metrics.summary(a.where("false")).collect()
    parts = metrics.compare_runs(a, results(spark, ROWS[:2]))
    assert [tuple(r)[1:] for r in parts["problems"].select("check", "key", "problem").collect()] == [("q3", "unexpected")] and parts["by_type"].where("is_total").first().n == 2
    got = metrics.bootstrap_sequential(pairs, 500, 3).first()
    deltas, rng = [-80.0, 50.0, -100.0], random.Random(3)
    means = sorted(sum(deltas[rng.randrange(3)] for _ in range(3)) / 3 for _ in range(500))
    assert (got.low, got.high, got.n) == (means[12], means[487], 3)
    hashed = metrics.bootstrap(pairs, 200).first()
    assert hashed.low <= hashed.delta_mean <= hashed.high


@pytest.mark.parametrize(("column", "value", "problem"), [(3, 101.0, "completeness_pct"), (3, float("nan"), "completeness_pct"), (3, None, "completeness_pct"), (4, -1.0, "document_recall_pct"), (5, -1, "invalid_extra_docs"), (2, None, "answer_correct")])
def test_metric_tampering(spark, column, value, problem):
    row = list(ROWS[0])
    row[column] = value
    got = validation.metric_bounds(results(spark, [tuple(row), *ROWS[1:]])).collect()
    assert [(r.key, r.problem) for r in got] == [("q1", problem)]


def test_stored_statistics(spark):
    own = metrics.group_stats(results(spark))
    assert validation.stored_stats(own, own).count() == 0
    assert {r.key for r in validation.stored_stats(own.where("grp is null or grp <> 'b'"), own).collect()} == {"b"}


def test_corrections(spark):
    from pyspark.sql import functions as F

    q = spark.createDataFrame([("q1", ["a"], "x"), ("q2", ["b"], "y")], "question_id string, expected_doc_ids array<string>, gold_answer string")
    plan = spark.createDataFrame([(0, "q1", 0), (1, "q2", 1)], "shard int, question_id string, ordinal int")
    updates = spark.createDataFrame([(0, "q1", True, [], ["a"], "x"), (0, "q2", True, ["z"], [], "y"), (1, "q2", False, ["z"], [], "y")], "shard int, question_id string, updated boolean, expected_doc_ids array<string>, valid_doc_ids array<string>, gold_answer string")
    c = judging.correction_records(q, updates, plan)
    assert [(r.question_id, r.doc_set_changed, r.gold_answer_changed) for r in c.collect()] == [("q1", True, False)]
    over = {r.question_id: (r.expected_doc_ids, r.valid_doc_ids) for r in judging.overlaid(q, c).collect()}
    assert over == {"q1": ([], ["a"]), "q2": (["b"], [])}
    told = spark.createDataFrame([("q1", False, 0.0), ("q2", True, 0.0)], "question_id string, corrected boolean, document_recall_pct double")
    audit = judging.audit_corrections(told, c, q, q.select("question_id", F.col("expected_doc_ids").alias("document_ids")))
    assert {(r.question_id, r.problem) for r in audit.collect()} == {("q1", "changes gold without flag"), ("q1", "after is incomplete"), ("q1", "no reasons"), ("q2", "flagged without record")}


def test_every_rule_of_the_corrections_audit(spark):
    """One record breaks one rule; a record that only adds valid documents breaks none."""
    ids = "array<string>"
    q = spark.createDataFrame([(f"q{i}", ["a"], "x", ["f"]) for i in range(12)], f"question_id string, expected_doc_ids {ids}, gold_answer string, answer_facts {ids}")
    fine = (["a"], "x", ["f"], ["b"], ["v"], "x", ["f"], ["r"], True, False)
    #       before ids, answer, facts, after ids, valid, answer, facts, reasons, set flag, answer flag
    rows = {
        "q0": ["a"] and (["a"], "x", ["f"], ["a"], ["v"], "x", ["f"], ["valid only"], False, False),
        "q1": fine,
        "q2": (["a"], "x", ["f"], ["a"], [], "x", ["f"], ["r"], False, False),
        "q3": (*fine[:8], True, True),
        "q4": (["a", "c"], *fine[1:]),
        "q5": (*fine[:7], [], True, False),
        "q6": (*fine[:6], None, ["r"], True, False),
        "q7": (["a"], "x", ["f"], ["a"], ["v"], "x", ["f"], ["r"], True, False),
        "q8": fine,
        "q9": fine,
        "strange": fine,
    }
    names = f"question_id string, before_ids {ids}, before_answer string, before_facts {ids}, after_ids {ids}, after_valid {ids}, after_answer string, after_facts {ids}, reasons {ids}, doc_set_changed boolean, gold_answer_changed boolean"
    c = spark.createDataFrame([(k, *v) for k, v in rows.items()] + [("q9", *fine)], names)
    flags = {"q0": False, "q2": False, "q8": False, "q10": True, "q11": False}
    told = spark.createDataFrame([(f"q{i}", flags.get(f"q{i}", True), 50.0 if i == 1 else 100.0 if i in (0, 2, 7) else 0.0) for i in range(12)] + [("strange", True, None)], "question_id string, corrected boolean, document_recall_pct double")
    answers = spark.createDataFrame([(f"q{i}", ["a"]) for i in range(12) if i != 3], f"question_id string, document_ids {ids}")
    want = {
        ("q1", "recall not reproduced"), ("q2", "changes nothing"), ("q3", "wrong answer flag"), ("q4", "before is not the original"), ("q5", "no reasons"), ("q6", "after is incomplete"),
        ("q7", "wrong set flag"), ("q8", "changes gold without flag"), ("q9", "repeated record"), ("q10", "flagged without record"), ("strange", "unknown question"),
    }
    assert {tuple(r) for r in judging.audit_corrections(told, c, q, answers).collect()} == want


def test_target_selection(spark):
    q = spark.createDataFrame([("q1",), ("q2",), ("q3",)], "question_id string")
    pick = lambda *ids: spark.createDataFrame(list(enumerate(ids)), "ordinal long, question_id string")
    assert [r.question_id for r in judging.select_questions(q, pick("q3", "q1"), 1).collect()] == ["q3"]
    assert [r.question_id for r in judging.select_questions(q, pick("q1", "q3", "q1")).collect()] == ["q1", "q3", "q1"]
    with pytest.raises(ValueError, match="unknown questions: nope"):
        judging.select_questions(q, pick("q1", "nope"))


def test_ledger(spark):
    log = spark.createDataFrame([("b", "i1", "errored", 1), ("b", "i1", "errored", 2), ("b", "i2", "errored", 1), ("b", "i2", "completed", 2), ("b", "i3", "pending", 1)], "batch string, id string, status string, seq long")
    assert [(r.id, r.attempts) for r in ledger.failed_items(log).collect()] == [("i1", 2)]
    sent = spark.createDataFrame([("i1",), ("i2",), ("i3",), ("i4",)], "id string")
    assert tuple(ledger.readiness(sent, log).first()) == (4, 1, 1, 2, 0, False, False)
    done, log = sent.where("id in ('i1', 'i2')"), log.where("id in ('i1', 'i2')")
    assert tuple(ledger.readiness(done, log).first()) == (2, 1, 1, 0, 0, True, False)
    assert ledger.readiness(done, log, accept_failures=True).first().ready
    waiting = ledger.readiness(done, log, accept_failures=True, open_batches=log).first()
    assert (waiting.unresolved, waiting.resolved, waiting.ready) == (1, False, False)
    states = ledger.batch_states(spark.createDataFrame([("b", 1, "sending"), ("b", 2, "sent"), ("c", 1, "sending")], "batch string, seq long, state string"), log, log)
    assert {tuple(r) for r in states.collect()} == {("b", "settled", 2, 1, 1), ("c", "sending", 0, 0, 0)}
    assert [tuple(r) for r in ledger.next_attempt(spark.createDataFrame([(0, 1), (0, 3)], "shard int, attempt int"), spark.createDataFrame([(0,), (1,)], "shard int")).orderBy("shard").collect()] == [(0, 4), (1, 1)]


def test_identity(spark):
    rows = [("b", "s", "t", "x"), ("a", "s", None, "é")]
    c = spark.createDataFrame(rows, "doc_id string, source_type string, title string, content string")
    want = hashlib.sha256("".join(f"{d}\x1f{t or ''}\x1f{x}\n" for d, _, t, x in sorted(rows)).encode()).hexdigest()
    assert identity.content_hash(c, "source_type").first().sha256 == want
    merkle = identity.content_merkle(c).first()
    assert merkle == identity.content_merkle(c.repartition(5)).first() and merkle != identity.content_merkle(c.limit(1)).first()
    assert identity.fingerprint({"b": 1, "a": 2}) == identity.fingerprint({"a": 2, "b": 1})


def test_checkout_reader(spark, tmp_path):
    root = tmp_path / "sources"
    (root / "jira").mkdir(parents=True)
    good = {"title_field_name": "summary", "content_field_names": ["description", "comments"], "dataset_doc_uuid": "x1", "summary": "S", "description": "D", "comments": ["a", "b"]}
    (root / "jira" / "1.json").write_text(json.dumps(good))
    (root / "jira" / "2.json").write_text(json.dumps(good | {"summary": "later copy"}))
    (root / "jira" / "3.json").write_text("{broken")
    (root / "jira" / "4.json").write_text(json.dumps({k: v for k, v in good.items() if k != "summary"} | {"dataset_doc_uuid": "x2"}))
    (root / "jira" / "note.txt").write_text("no")
    got = sources.read_checkout(spark, str(root)).collect()
    assert [tuple(r) for r in got] == [("x1", "jira", "S", "description:\nD\n\ncomments:\na\nb", 29)]


def test_journal_reader(spark, tmp_path):
    torn, broken = tmp_path / "torn", tmp_path / "broken"
    torn.write_text('{"batch": 1}\n{"batch": 2}\n{"bat')
    broken.write_text('{"batch": 1}\n{"bat\n{"batch": 3}\n')
    rows, was_torn = sources.read_journal(spark, str(torn), "batch long")
    assert [r.batch for r in rows.collect()] == [1, 2] and was_torn
    with pytest.raises(ValueError, match="before the end"):
        sources.read_journal(spark, str(broken), "batch long")


def test_lines_results_and_append(spark, tmp_path):
    from pyspark.sql import functions as F

    (tmp_path / "a.jsonl").write_text('{"question_id": "q", "answer": "x", "document_ids": ["d"]}\n\n')
    assert sources.read_lines(spark, str(tmp_path / "a.jsonl"), sources.ANSWER).count() == 1
    (tmp_path / "bad.jsonl").write_text("{nope\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        sources.read_lines(spark, str(tmp_path / "bad.jsonl"), sources.ANSWER).collect()
    names = [f.split()[0] for f in sources.RESULT.split(", ")]
    (tmp_path / "r.json").write_text(json.dumps({"questions": [dict(zip(names, r, strict=True)) for r in ROWS]}, indent=1))
    assert sorted(tuple(r) for r in sources.read_results(spark, str(tmp_path / "r.json")).collect()) == sorted(ROWS)
    docs = spark.createDataFrame([("a", "s", "t", "1", 1, 1), ("a", "s", "t", "0", 1, 0), ("b", "s", "t", "x", 1, 0)], "doc_id string, source_type string, title string, content string, content_len int, priority int")
    sources.append_new(docs, None, str(tmp_path / "c"))
    sources.append_new(docs, spark.read.parquet(str(tmp_path / "c")), str(tmp_path / "c"))
    assert sorted((r.doc_id, r.content) for r in spark.read.parquet(str(tmp_path / "c")).collect()) == [("a", "0"), ("b", "x")]
    saved = spark.createDataFrame([("q1", ["a"], ["b"]), ("q2", None, ["c"])], "question_id string, retrieved_doc_ids array<string>, document_ids array<string>")
    assert {r.provenance for r in sources.chosen_retrieval(saved).collect()} == {"submitted ids"}
    with pytest.raises(ValueError, match="repeated questions: q1"):
        sources.chosen_retrieval(saved.union(saved.where("question_id = 'q1'")))
    neither = saved.select("question_id", "retrieved_doc_ids", F.when(F.col("question_id") == "q1", F.col("document_ids")).alias("document_ids"))
    answers_ = spark.createDataFrame([("q9", ["z"]), ("q8", None)], "question_id string, document_ids array<string>")
    assert {(r.question_id, tuple(r.document_ids), r.provenance) for r in sources.chosen_retrieval(neither, answers_).collect()} == {("q9", ("z",), "answers"), ("q8", (), "answers")}
    (tmp_path / "k.jsonl").write_text('{"question_id": "q", "answer": "old"}\n\n{"question_id": "r", "answer": "x"}\n{"question_id": "q", "answer": "new"}\n')
    assert {(r.question_id, r.answer) for r in sources.read_keyed(spark, str(tmp_path / "k.jsonl"), sources.ANSWER).collect()} == {("q", "new"), ("r", "x")}
    (tmp_path / "c.json").write_text(json.dumps([{"_config": {"top": 3}}, {"question_id": "q", "stage": "answered"}]))
    header, rows = sources.read_checkpoint(spark, str(tmp_path / "c.json"), "question_id string, stage string")
    assert header == {"top": 3} and [tuple(r) for r in rows.collect()] == [("q", "answered")]
    (tmp_path / "ids").write_text("q2\n\nq1\n")
    assert [r.question_id for r in sources.read_ids(spark, str(tmp_path / "ids")).orderBy("ordinal").collect()] == ["q2", "q1"]


def test_answers_fall_back_to_the_draft(spark):
    rows = spark.createDataFrame([("q", "where is it", "Far away. It is where we are. No")], "question_id string, question string, context string")
    assert tuple(answers.generate(rows).first()) == ("q", "It is where we are", True, False, False)

    def failing(stage, question, text):
        if stage == "rewrite":
            raise RuntimeError("down")
        return stage

    assert tuple(answers.generate(rows, failing).first()) == ("q", "draft", True, True, False)


def test_digests(spark, tmp_path):
    (tmp_path / "a").write_text("1")
    (tmp_path / "b").write_text("2")
    now = sources.file_digests(spark, str(tmp_path))
    one = [r.asDict() for r in now.collect()]
    stored = spark.createDataFrame([(r["path"], "old", 0) for r in one] + [(one[0]["path"], one[0]["sha256"], 1), ("gone", "x", 0)], "path string, sha256 string, at long")
    assert sorted(r.problem for r in validation.digests(stored, now).collect()) == ["changed", "missing"]


def test_gold_of_short_passages(spark):
    passages = ["gamma", "lta eps", "two words", " ", "", None, "alpha beta gamma", "absent", "gamma"]
    contents = ["alpha beta gamma", "delta epsilon", "gammas and two wordsmiths", "", "x"]
    q = spark.createDataFrame([(f"q{i}", p) for i, p in enumerate(passages)], "question_id string, passage string")
    c = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(contents)], "doc_id string, content string")
    got = {r.question_id: r.expected_doc_ids for r in retrieval.gold_sets(q, retrieval.gold_pairs(q, c)).collect()}
    assert got == {f"q{i}": [f"d{j}" for j, t in enumerate(contents) if p is not None and p in t] for i, p in enumerate(passages)}
