"""The driver's tables as domain entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as corpus rows; the title is the text's first 40 characters."""
    d = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    return d.select(F.concat(F.lit("d"), F.col("doc_id")).alias("doc_id"), F.col("source").alias("source_type"), F.substring(text, 1, 40).alias("title"), text.alias("content"), F.length(text).alias("content_len"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark items as questions whose gold is every document that holds the item's text."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.concat(F.lit("q"), F.col("item_id")).alias("question_id"), F.col("text").alias("question"), F.col("text").alias("passage"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic result rows from labels and documents: a row for each labelled document."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    n = F.col("n_chars")
    return lab.join(d.select("doc_id", "lang", "n_chars", "source"), "doc_id").select(
        F.concat(F.lit("d"), F.col("doc_id")).alias("question_id"), F.col("lang").alias("question_type"), "source", (F.col("quality") == 1).alias("answer_correct"), (n % 101).cast("double").alias("completeness_pct"),
        F.when(n % 7 != 0, (n % 5 * 25).cast("double")).alias("document_recall_pct"), F.when(n % 7 != 0, (n % 4).cast("int")).alias("invalid_extra_docs"), (F.col("toxic") == 1).alias("corrected"),
    )


def other_results(a: DataFrame) -> DataFrame:
    """A second synthetic run: correctness flips where completeness is a multiple of nine, completeness moves by three."""
    ok = F.when(F.col("completeness_pct") % 9 == 0, ~F.col("answer_correct")).otherwise(F.col("answer_correct"))
    return a.withColumn("answer_correct", ok).withColumn("completeness_pct", F.least(F.lit(100.0), F.col("completeness_pct") + 3))


def statuses(events: DataFrame) -> DataFrame:
    """events as a status log: batch is the day, id the user, order the event id."""
    status = F.when(F.col("event_type") == "error", "errored").when(F.col("event_type") == "purchase", "completed").otherwise("pending")
    return events.select(F.date_format("ts", "yyyy-MM-dd").alias("batch"), F.concat(F.lit("u"), F.col("user_id")).alias("id"), status.alias("status"), F.col("event_id").alias("seq"), "ts")


def status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statuses(table(spark, sf_dir, "events")).drop("ts")


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as messages of a thread: (doc_id, i, author, body)."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.concat(F.lit("c"), F.col("conv_id")).alias("doc_id"), F.col("turn").cast("int").alias("i"), F.col("role").alias("author"), F.coalesce("text", F.lit("")).alias("body"))
