"""Commands over files: python -m corvane.plans.cli COMMAND. Exit codes: 0 fine, 1 bad input, 2 done but incomplete."""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import context, items, judging, metrics, retrieval, validation
from ..sources import corpus as sources
from . import answers, report, workspace

QUESTION = "question_id string, question string, question_type string, source_types array<string>, expected_doc_ids array<string>, gold_answer string, answer_facts array<string>, valid_doc_ids array<string>"
GOLD = "expected_doc_ids:array<string>,gold_answer:string,answer_facts:array<string>,valid_doc_ids:array<string>"
CORRECTION = f"question_id string, before struct<{GOLD}>, after struct<{GOLD}>, update_reasons array<string>, doc_set_changed boolean, gold_answer_changed boolean"
JUDGED = "shard int, question_id string, answer_correct boolean, completeness_pct double"
CHECKPOINT = "question_id string, stage string, answer string, document_ids array<string>, retrieved_doc_ids array<string>, context_docs array<string>, context_chars int, context_sha256 string"


def told(df) -> None:
    for row in df.toJSON().collect():
        print(row)


def stats(spark, a) -> int:
    told(metrics.group_stats(sources.read_results(spark, a.results)))
    return 0


def report_(spark, a) -> int:
    board = json.load(open(a.leaderboard, encoding="utf-8")) if a.leaderboard else None
    print(report.markdown(a.title, sources.read_results(spark, a.results, placed=True), leaderboard=board))
    return 0


def compare(spark, a) -> int:
    x, y = sources.read_results(spark, a.a), sources.read_results(spark, a.b)
    parts = metrics.compare_runs(x, y, draws=a.draws, seed=a.seed)
    for name, part in parts.items():
        if name != "interval":
            told(part.select(F.lit(name).alias("part"), "*"))
    told(metrics.bootstrap_sequential(metrics.paired(x, y), a.draws, a.seed))
    return 0 if parts["problems"].isEmpty() else 2


def recall(spark, a) -> int:
    questions = sources.read_lines(spark, a.questions, QUESTION)
    rows = metrics.recall_rows(sources.read_lines(spark, a.answers, sources.ANSWER), questions, report.DEPTHS)
    told(rows.groupBy("k").agg(F.avg("recall_pct").alias("recall_pct"), F.avg("invalid_extra").alias("invalid_extra"), F.count(F.lit(1)).alias("n")))
    if a.other:
        other = metrics.recall_rows(sources.read_lines(spark, a.other, sources.ANSWER), questions, report.DEPTHS)
        told(metrics.recall_comparison(rows, other))
        told(metrics.coverage_changes(rows, other))
    return 0


def audit_corrections(spark, a) -> int:
    q, records = sources.read_lines(spark, a.questions, QUESTION), sources.read_lines(spark, a.corrections, CORRECTION)
    flat = records.select(
        "question_id", F.col("before.expected_doc_ids").alias("before_ids"), F.col("before.gold_answer").alias("before_answer"), F.col("before.answer_facts").alias("before_facts"), F.col("after.expected_doc_ids").alias("after_ids"),
        F.col("after.valid_doc_ids").alias("after_valid"), F.col("after.gold_answer").alias("after_answer"), F.col("after.answer_facts").alias("after_facts"), F.col("update_reasons").alias("reasons"), "doc_set_changed", "gold_answer_changed",
    )
    results = sources.read_results(spark, a.results)
    answers = sources.read_lines(spark, a.answers, sources.ANSWER) if a.answers else spark.createDataFrame([], sources.ANSWER)
    problems = judging.audit_corrections(results, flat, q, answers)
    told(judging.correction_counts(results, flat))
    told(problems)
    return 0 if problems.isEmpty() else 1


def generate(spark, a) -> int:
    """Retrieves, builds contexts and answers, question by question only where the run folder has no answer yet."""
    q, corpus = sources.read_lines(spark, a.questions, QUESTION), sources.read_checkout(spark, a.checkout)
    fs = spark._jvm.org.apache.hadoop.fs.Path(f"{a.run}/answers")
    there = fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs)
    done = sources.read_lines(spark, f"{a.run}/answers", sources.ANSWER) if there else None
    if done is not None and (left := validation.selection(done.withColumn("stage", F.lit("answered")), q, a.force).limit(5).collect()):
        raise ValueError(f"the run holds questions that are not selected: {', '.join(r['key'] for r in left)}")
    todo = q if done is None else q.join(done.select("question_id"), "question_id", "left_anti")
    hits = workspace.kept(retrieval.lexical(todo, corpus, a.k), "hits")
    none = spark.createDataFrame([], "question_id string, rank int, chunk_id string, chunk_content string")
    contexts = context.build(context.hydrate(hits.select("question_id", F.col("rank").alias("doc_rank"), "doc_id"), corpus, none), todo, a.docs, a.max_chars)
    ids = hits.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("document_ids"))
    out = answers.generate(contexts.join(todo.select("question_id", "question"), "question_id"), _loaded(a.model) if a.model else answers.quoting_stub).select("question_id", "answer").join(ids, "question_id", "left")
    out.select("question_id", "answer", F.coalesce("document_ids", F.expr("cast(array() as array<string>)")).alias("document_ids")).write.mode("append").json(f"{a.run}/answers")
    return 0


def judge(spark, a) -> int:
    """Scores answers shard by shard; shards that are complete in the run folder are left as they are."""
    q, given = sources.read_lines(spark, a.questions, QUESTION), sources.read_lines(spark, a.answers, sources.ANSWER)
    bad = validation.answers(given, q)
    if not bad.isEmpty():
        told(bad)
        return 1
    plan = workspace.kept(judging.shard_plan(given, a.shards), "plan")
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{a.run}/judged")
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    done = judging.complete_shards(spark.read.schema(JUDGED).json(f"{a.run}/judged"), plan) if there else None
    judging.judge(given, q, plan, _loaded(a.scorer), done).write.mode("append").json(f"{a.run}/judged")
    rows, problems = judging.merge(spark.read.schema(JUDGED).json(f"{a.run}/judged"), plan)
    told(problems)
    told(rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.expr(metrics.SCORE)).alias("combined")))
    return 0 if problems.isEmpty() else 2


def _loaded(name: str):
    """The function that module:function names."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def doctor(spark, a) -> int:
    """What a run needs: versions, the shared folder, and the files given."""
    told(spark.createDataFrame([("python", sys.version.split()[0]), ("spark", spark.version), ("master", spark.sparkContext.master), ("shared folder", spark.conf.get("spark.checkpoint.dir", "unset"))], "what string, is string"))
    missing = [p for p in a.path or [] if not spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p))]
    for p in missing:
        print(f"missing: {p}")
    return 1 if missing else 0


def verify(spark, a) -> int:
    r, q = sources.read_results(spark, a.results), sources.read_lines(spark, a.questions, QUESTION)
    problems = validation.metric_bounds(r).union(validation.duplicates(r, "question_id")).union(validation.coverage(r, q))
    done = ["metric", "duplicate id", "coverage"]
    if a.answers:
        submitted = sources.read_lines(spark, a.answers, sources.ANSWER)
        problems = problems.union(validation.answers(submitted, q)).union(validation.retrieval_against_results(r, validation.retrieval_metrics(q, submitted)))
        done += ["answer", "retrieval metric"]
    states = validation.verdict(problems, done, ["answer"] if a.strict else [])
    told(problems)
    told(states)
    bad = {s["state"] for s in states.collect()}
    return 1 if "fail" in bad else 2 if "incomplete" in bad else 0


def ingest(spark, a) -> int:
    corpus = sources.read_checkout(spark, a.checkout, a.source or None)
    found = items.typed_items(corpus)
    told(items.kind_counts(found))
    if a.out:
        found.write.mode("overwrite").parquet(a.out)
    return 0


def search(spark, a) -> int:
    q = sources.read_lines(spark, a.questions, QUESTION)
    told(retrieval.lexical(q, sources.read_checkout(spark, a.checkout), a.k))
    return 0


def inspect(spark, a) -> int:
    for path, schema in ((a.questions, QUESTION), (a.answers, sources.ANSWER), (a.checkpoint, CHECKPOINT)):
        if path:
            told(sources.read_lines(spark, path, schema).where(F.col("question_id") == a.id))
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="corvane")
    sub = p.add_subparsers(required=True)

    def command(name, does, **options):
        c = sub.add_parser(name)
        c.set_defaults(does=does)
        for k, v in options.items():
            c.add_argument(f"--{k}", **v)

    need, maybe = {"required": True}, {}
    command("stats", stats, results=need)
    command("report", report_, results=need, title={"default": "results"}, leaderboard=maybe)
    command("compare", compare, a=need, b=need, draws={"type": int, "default": 10_000}, seed={"type": int, "default": 0})
    command("recall", recall, answers=need, questions=need, other=maybe)
    command("audit-corrections", audit_corrections, results=need, corrections=need, questions=need, answers=maybe)
    command("generate", generate, run=need, questions=need, checkout=need, model=maybe, k={"type": int, "default": 50}, docs={"type": int, "default": 12}, max_chars={"type": int, "default": 240_000}, force={"action": "store_true"})
    command("judge", judge, run=need, questions=need, answers=need, scorer=need, shards={"type": int, "default": 20})
    command("doctor", doctor, path={"action": "append"})
    command("verify", verify, results=need, questions=need, answers=maybe, strict={"action": "store_true"})
    command("ingest", ingest, checkout=need, source={"action": "append"}, out=maybe)
    command("search", search, checkout=need, questions=need, k={"type": int, "default": 10})
    command("inspect", inspect, id=need, questions=maybe, answers=maybe, checkpoint=maybe)
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    try:
        return a.does(spark, a)
    except (ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
