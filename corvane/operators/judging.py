"""Shards of answers, their merge, and corrections of gold sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordering import row_numbers

EMPTY = "cast(array() as array<string>)"


def select_questions(questions: DataFrame, targets: DataFrame, n: int | None = None) -> DataFrame:
    """Questions in the order of targets (ordinal, question_id), the first n. A repeated target is selected as often; an unknown one is an error."""
    if found := [r[0] for r in targets.join(questions.select("question_id"), "question_id", "left_anti").select("question_id").limit(5).collect()]:
        raise ValueError(f"unknown questions: {', '.join(found)}")
    out = questions.join(targets, "question_id").orderBy("ordinal")
    return out if n is None else out.limit(n)


def shard_plan(ids: DataFrame, shards: int) -> DataFrame:
    """(shard, question_id, ordinal): contiguous shards of ceil(n / shards) ids in id order, so there may be fewer."""
    out = row_numbers(ids.select("question_id"), "question_id", total="n")
    return out.select(F.floor(F.col("ordinal") / F.ceil(F.col("n") / shards)).cast("int").alias("shard"), "question_id", "ordinal")


def merge(parts: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, problems): rows (shard, question_id, ...) of the shard that owns the question; problems name repeated, missing and strange ones."""
    owned = parts.join(plan.select("shard", "question_id"), ["shard", "question_id"])
    state = plan.select("question_id").join(owned.groupBy("question_id").agg(F.count(F.lit(1)).alias("n")), "question_id", "left")
    problems = state.select("question_id", F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated").alias("problem")).where("problem is not null")
    strange = parts.select("shard", "question_id").join(plan, ["shard", "question_id"], "left_anti").select("question_id", F.lit("not this shard's").alias("problem"))
    return owned, problems.union(strange)


def complete_shards(parts: DataFrame, plan: DataFrame) -> DataFrame:
    """(shard, complete): whether all of a shard's questions have a row."""
    have = parts.select("shard", "question_id").distinct().withColumn("have", F.lit(1))
    return plan.join(have, ["shard", "question_id"], "left").groupBy("shard").agg((F.count("have") == F.count(F.lit(1))).alias("complete"))


def same_set(a: str, b: str):
    return F.array_sort(F.array_distinct(F.col(a))).eqNullSafe(F.array_sort(F.array_distinct(F.col(b))))


def correction_records(originals: DataFrame, updates: DataFrame, plan: DataFrame) -> DataFrame:
    """Corrections from shards' updated questions: only those the shard owns and marks as updated.

    Facts and reasons are told where originals (answer_facts) and updates (answer_facts, update_reasons) have them.
    """
    mine = updates.where("updated").join(plan.select("shard", "question_id"), ["shard", "question_id"])
    some = lambda df, name: F.col(name) if name in df.columns else F.lit(None).cast("array<string>")
    after = mine.select("question_id", F.col("expected_doc_ids").alias("after_ids"), F.col("valid_doc_ids").alias("after_valid"), F.col("gold_answer").alias("after_answer"), some(mine, "answer_facts").alias("after_facts"), some(mine, "update_reasons").alias("reasons"))
    before = originals.select("question_id", F.col("expected_doc_ids").alias("before_ids"), F.col("gold_answer").alias("before_answer"), some(originals, "answer_facts").alias("before_facts"))
    out = before.join(after, "question_id")
    return out.withColumn("doc_set_changed", ~same_set("before_ids", "after_ids")).withColumn("gold_answer_changed", ~F.col("before_answer").eqNullSafe(F.col("after_answer")))


def overlaid(questions: DataFrame, corrections: DataFrame) -> DataFrame:
    """Gold sets with corrections: a correction replaces both sets, empty ones too."""
    c = corrections.select("question_id", "after_ids", "after_valid", F.lit(True).alias("corrected"))
    out = questions.join(c, "question_id", "left")
    pick = lambda new, old: F.when(F.col("corrected"), F.coalesce(new, F.expr(EMPTY))).otherwise(F.coalesce(old, F.expr(EMPTY)))
    valid = F.col("valid_doc_ids") if "valid_doc_ids" in questions.columns else F.expr(EMPTY)
    return out.select("question_id", pick(F.col("after_ids"), F.col("expected_doc_ids")).alias("expected_doc_ids"), pick(F.col("after_valid"), valid).alias("valid_doc_ids"), F.coalesce("corrected", F.lit(False)).alias("corrected"))


def audit_corrections(results: DataFrame, corrections: DataFrame, questions: DataFrame, answers: DataFrame) -> DataFrame:
    """(question_id, problem), a row for each broken rule.

    results: question_id, corrected, document_recall_pct; questions: the originals; answers: question_id, document_ids.
    Only a record that changes the gold set or the gold answer goes with a flagged result; one that adds valid
    documents alone is a record too. One pass over the records: each meets its result, question and answer once.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    filled = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    facts = F.col("answer_facts") if "answer_facts" in questions.columns else F.lit(None).cast("array<string>")
    original = questions.select("question_id", F.col("expected_doc_ids").alias("own_ids"), F.col("gold_answer").alias("own_answer"), facts.alias("own_facts"), F.lit(True).alias("known"))
    told = results.select("question_id", yes("corrected").alias("flagged"), "document_recall_pct")
    w = Window.partitionBy("question_id")
    c = corrections.withColumn("records", F.count(F.lit(1)).over(w)).join(original, "question_id", "left").join(told, "question_id", "left")
    c = c.join(answers.select("question_id", F.array_distinct("document_ids").alias("submitted")), "question_id", "left")
    gold = F.array_distinct(F.coalesce("after_ids", F.expr(EMPTY)))
    recall = 100.0 * F.size(F.array_intersect("submitted", gold)) / F.size(gold)
    changed = yes("doc_set_changed") | yes("gold_answer_changed")
    rules = {
        "repeated record": F.col("records") > 1,
        "changes gold without flag": changed & ~yes("flagged"),
        "changes nothing": ~changed & ~filled("after_valid"),
        "unknown question": F.col("known").isNull(),
    }
    of_known = {
        "wrong set flag": yes("doc_set_changed") == same_set("before_ids", "after_ids"),
        "wrong answer flag": yes("gold_answer_changed") == F.col("before_answer").eqNullSafe(F.col("after_answer")),
        "recall not reproduced": (F.size(gold) > 0) & (F.abs(recall - F.col("document_recall_pct")) > 0.011),
        "before is not the original": ~(F.col("before_ids").eqNullSafe(F.col("own_ids")) & F.col("before_answer").eqNullSafe(F.col("own_answer")) & F.col("before_facts").eqNullSafe(F.col("own_facts"))),
        "after is incomplete": ~filled("after_ids") | (F.coalesce("after_answer", F.lit("")) == "") | F.col("after_facts").isNull(),
        "no reasons": ~filled("reasons"),
    }
    broken = [F.when(cond, F.lit(name)) for name, cond in rules.items()] + [F.when(yes("known") & cond, F.lit(name)) for name, cond in of_known.items()]
    out = c.select("question_id", F.explode(F.array_compact(F.array(*broken))).alias("problem"))
    return out.union(told.where("flagged").join(corrections, "question_id", "left_anti").select("question_id", F.lit("flagged without record").alias("problem")))


def correction_counts(results: DataFrame, corrections: DataFrame) -> DataFrame:
    yes = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0))
    own = corrections.agg(yes("doc_set_changed").alias("doc_set_changed"), yes("gold_answer_changed").alias("gold_answer_changed"), F.count(F.lit(1)).alias("records"))
    return own.crossJoin(results.agg(F.coalesce(F.sum((~F.col("corrected")).cast("long")), F.lit(0)).alias("uncorrected")))  # one row each


def judge(answers: DataFrame, questions: DataFrame, plan: DataFrame, scorer: Callable[[dict], dict], done: DataFrame | None = None) -> DataFrame:
    """(shard, question_id, answer_correct, completeness_pct): scorer over each answer, shards in parallel.

    Shards in done (shard, complete) that are complete are left out; a shard's rows depend on the shard alone, so a
    repeated run writes the same.
    """
    if done is not None:
        plan = plan.join(done.where("complete").select("shard"), "shard", "left_anti")
    rows = plan.select("shard", "question_id").join(answers, "question_id").join(questions, "question_id").repartition("shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [{"shard": r["shard"], "question_id": r["question_id"], **scorer(r)} for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([t[c] for t in told], k) for c, k in (("shard", pa.int32()), ("question_id", pa.string()), ("answer_correct", pa.bool_()), ("completeness_pct", pa.float64()))], ["shard", "question_id", "answer_correct", "completeness_pct"])

    return rows.mapInArrow(run, "shard int, question_id string, answer_correct boolean, completeness_pct double")
