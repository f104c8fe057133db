"""Checks as rows: each returns (check, key, problem), nothing if all is well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import leaks

TOLERANCE = 0.011
CHECKED = ("correctness", "completeness", "combined", "recall", "invalid_extra")


def _rows(df: DataFrame, check: str, key: Column, problem: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), key.cast("string").alias("key"), problem.alias("problem")).where("problem is not null")


def _all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionAll, parts)


def duplicates(df: DataFrame, key: str, check: str = "duplicate id") -> DataFrame:
    many = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return _rows(many, check, F.col(key), F.concat(F.col("n").cast("string"), F.lit(" rows")))


def coverage(actual: DataFrame, expected: DataFrame, key: str = "question_id") -> DataFrame:
    """Ids of one side only."""
    a, e = actual.select(key).distinct(), expected.select(key).distinct()
    return _all(_rows(e.join(a, key, "left_anti"), "coverage", F.col(key), F.lit("missing")), _rows(a.join(e, key, "left_anti"), "coverage", F.col(key), F.lit("unexpected")))


def metric_bounds(results: DataFrame) -> DataFrame:
    """Values that are absent, not finite or out of range; recall and extra may be null."""

    def pct(name: str, optional: bool) -> Column:
        c = F.col(name).cast("double")
        bad = F.when(c.isNull(), not optional).otherwise(F.isnan(c) | (c < 0) | (c > 100))
        return F.when(bad, F.lit(name))

    extra = F.when(F.col("invalid_extra_docs") < 0, F.lit("invalid_extra_docs"))
    wrong = F.array_compact(F.array(pct("completeness_pct", False), pct("document_recall_pct", True), extra, F.when(F.col("answer_correct").isNull(), F.lit("answer_correct"))))
    return _rows(results, "metric", F.col("question_id"), F.when(F.size(wrong) > 0, F.array_join(wrong, ",")))


def stored_stats(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Statistics (grp, n and CHECKED) that differ from recomputed ones by over TOLERANCE, or are on one side only."""
    names = ("n", *CHECKED)
    s, r = (df.select(F.coalesce("grp", F.lit("(all)")).alias("grp"), *[F.col(c).cast("double").alias(f"{p}_{c}") for c in names]) for df, p in ((stored, "s"), (recomputed, "r")))
    both = s.join(r, "grp", "full_outer")
    off = lambda c: F.when(F.col(f"s_{c}").isNull() | F.col(f"r_{c}").isNull() | F.isnan(f"s_{c}") | (F.abs(F.col(f"s_{c}") - F.col(f"r_{c}")) > TOLERANCE), F.lit(c))
    wrong = F.array_compact(F.array(*map(off, names)))
    return _rows(both, "statistic", F.col("grp"), F.when(F.size(wrong) > 0, F.array_join(wrong, ",")))


def contexts(rows: DataFrame) -> DataFrame:
    """Context rows whose hash or length is not their text's, that leak a marker or repeat a document."""
    wrong = F.array_compact(F.array(
        F.when(~F.col("context_sha256").eqNullSafe(F.sha2("context", 256)), F.lit("hash")), F.when(~F.col("context_chars").eqNullSafe(F.length("context")), F.lit("length")),
        F.when(leaks(F.col("context")), F.lit("leak")), F.when(F.size(F.array_distinct("context_docs")) != F.size("context_docs"), F.lit("repeated document")),
    ))
    return _all(_rows(rows, "context", F.col("question_id"), F.when(F.size(wrong) > 0, F.array_join(wrong, ","))), duplicates(rows, "question_id", "context"))


def contexts_against_checkpoint(rows: DataFrame, checkpoint: DataFrame) -> DataFrame:
    c = checkpoint.select("question_id", F.col("context_sha256").alias("want"), F.col("context_docs").alias("want_docs"))
    both = rows.select("question_id", F.col("context_sha256").alias("have"), F.col("context_docs").alias("have_docs")).join(c, "question_id", "full_outer")
    problem = F.when(F.col("want").isNull(), "not in checkpoint").when(F.col("have").isNull(), "no context").when(F.col("have") != F.col("want"), "other text").when(F.col("have_docs") != F.col("want_docs"), "other documents")
    return _rows(both, "context and checkpoint", F.col("question_id"), problem)


def checkpoint(rows: DataFrame) -> DataFrame:
    """Submitted ids that are no prefix of the retrieved ones, and repeated questions."""
    head = F.slice("retrieved_doc_ids", 1, F.greatest(F.size("document_ids"), F.lit(0)))
    return _all(_rows(rows, "prefix", F.col("question_id"), F.when(~F.col("document_ids").eqNullSafe(head), F.lit("no prefix of the ranking"))), duplicates(rows, "question_id", "checkpoint"))


def answers_against_checkpoint(answers: DataFrame, rows: DataFrame) -> DataFrame:
    c = rows.select("question_id", F.col("answer").alias("want"), F.col("document_ids").alias("want_ids"))
    both = answers.join(c, "question_id")
    problem = F.when(~F.col("answer").eqNullSafe(F.col("want")), "other answer").when(~F.col("document_ids").eqNullSafe(F.col("want_ids")), "other documents")
    return _rows(both, "answer and checkpoint", F.col("question_id"), problem)


def answers(rows: DataFrame, questions: DataFrame, expected: int | None = None) -> DataFrame:
    """Answers that cannot be judged: no text or ids, repeated or unknown questions, another number than expected."""
    blank = F.when(F.col("answer").isNull(), "no answer").when(F.col("document_ids").isNull(), "no document ids")
    unknown = rows.select("question_id").distinct().join(questions.select("question_id"), "question_id", "left_anti")
    parts = [_rows(rows, "answer", F.col("question_id"), blank), duplicates(rows, "question_id", "answer"), _rows(unknown, "answer", F.col("question_id"), F.lit("unknown question"))]
    if expected is not None:
        n = rows.agg(F.count(F.lit(1)).alias("n"))
        parts.append(_rows(n, "answer", F.lit("(all)"), F.when(F.col("n") != expected, F.concat(F.col("n").cast("string"), F.lit(f" answers, {expected} expected")))))
    return _all(*parts)


def retrieval_metrics(gold: DataFrame, submitted: DataFrame) -> DataFrame:
    """(question_id, recall_pct, invalid_extra) over sets; documents that are valid though not gold are no extras."""
    g = gold.select("question_id", F.array_distinct("expected_doc_ids").alias("gold"), F.coalesce("valid_doc_ids", F.expr("cast(array() as array<string>)")).alias("valid"))
    out = submitted.select("question_id", F.array_distinct("document_ids").alias("ids")).join(g, "question_id")
    recall = F.when(F.size("gold") > 0, 100.0 * F.size(F.array_intersect("ids", "gold")) / F.size("gold"))
    extra = F.when(F.size("gold") > 0, F.size(F.array_except(F.array_except("ids", "gold"), "valid")).cast("long"))
    return out.select("question_id", recall.alias("recall_pct"), extra.alias("invalid_extra"))


def retrieval_against_results(results: DataFrame, recomputed: DataFrame) -> DataFrame:
    both = results.join(recomputed, "question_id")
    off = F.abs(F.col("document_recall_pct") - F.col("recall_pct")) > TOLERANCE
    problem = F.when(F.col("document_recall_pct").isNull() != F.col("recall_pct").isNull(), "recall").when(off, "recall").when(~F.col("invalid_extra_docs").cast("long").eqNullSafe(F.col("invalid_extra")), "invalid extra")
    return _rows(both, "retrieval metric", F.col("question_id"), problem)


def verdict(checks: DataFrame, done: list[str], wanted: list[str]) -> DataFrame:
    """(check, state): ok, fail, or incomplete for a wanted check that was not done."""
    spark = checks.sparkSession
    told = spark.createDataFrame([(c, c in done) for c in dict.fromkeys([*done, *wanted])], "check string, done boolean")
    bad = checks.groupBy("check").agg(F.count(F.lit(1)).alias("n"))
    return told.join(bad, "check", "left").select("check", F.when(~F.col("done"), "incomplete").when(F.col("n") > 0, "fail").otherwise("ok").alias("state"), F.coalesce("n", F.lit(0)).alias("problems"))


def digests(stored: DataFrame, actual: DataFrame) -> DataFrame:
    """Files (path, sha256) that changed, are missing or were never recorded; of several records of a file the latest counts."""
    latest = stored.groupBy("path").agg(F.max_by("sha256", "at").alias("want"))
    both = latest.join(actual.select("path", F.col("sha256").alias("have")), "path", "full_outer")
    problem = F.when(F.col("want").isNull(), "not recorded").when(F.col("have").isNull(), "missing").when(F.col("want") != F.col("have"), "changed")
    return _rows(both, "checksum", F.col("path"), problem)


def selection(saved: DataFrame, requested: DataFrame, force: bool = False, done: tuple[str, ...] = ("answered",)) -> DataFrame:
    """Saved questions that a resumed run would leave out: a run may extend its selection, never narrow it.

    With force only those are told whose stage is not one of done; the others are exported besides the selection.
    """
    extra = saved.join(requested.select("question_id"), "question_id", "left_anti")
    if force:
        return _rows(extra.where(~F.coalesce(F.col("stage").isin(*done), F.lit(False))), "selection", F.col("question_id"), F.lit("left out and not complete"))
    return _rows(extra, "selection", F.col("question_id"), F.lit("left out"))


#: An answer's keys and their kinds, as Spark tells a JSON value's; a list without elements has no kind of them.
ANSWER_SHAPES = tuple(f"OBJECT<answer: STRING, document_ids: ARRAY<{kind}>, question_id: STRING>" for kind in ("STRING", "VOID"))


def answer_shape(lines: DataFrame) -> DataFrame:
    """Lines (value) of an answer file that are not exactly a question's id, a text and a list of ids."""
    shape = F.schema_of_variant(F.try_parse_json("value"))
    return _rows(lines.where("trim(value) <> ''"), "answer shape", F.substring("value", 1, 80), F.when(~F.coalesce(shape.isin(*ANSWER_SHAPES), F.lit(False)), F.coalesce(shape, F.lit("no JSON"))))
