"""The ledger of an ingestion: statuses, failures, retries and whether all is done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import document_of
from .ordering import consecutive_batches

SETTLED, FAILED = "completed", "errored"


def latest_status(log: DataFrame) -> DataFrame:
    """The last status of each (batch, id) of an append-only log (batch, id, status, seq)."""
    return log.groupBy("batch", "id").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))


def adopted(log: DataFrame, open_batches: DataFrame) -> DataFrame:
    """Logged final statuses of items in batches that are still open."""
    return latest_status(log).where(F.col("status").isin(SETTLED, FAILED)).join(open_batches.select("batch", "id"), ["batch", "id"])


def failed_items(log: DataFrame) -> DataFrame:
    """(id, attempts, seq): items whose last final status is a failure, and how often they failed in a row."""
    final = log.where(F.col("status").isin(SETTLED, FAILED))
    last = final.groupBy("id").agg(F.max(F.when(F.col("status") == SETTLED, F.col("seq"))).alias("good"), F.max("seq").alias("seq"))
    since = final.where(F.col("status") == FAILED).select("id", F.col("seq").alias("at")).join(last, "id").where("good is null or at > good")
    return since.groupBy("id", "seq").agg(F.count(F.lit(1)).alias("attempts")).select("id", "attempts", "seq")


def failed_documents(failed: DataFrame, in_flight: DataFrame | None = None) -> DataFrame:
    """(doc_id, ids): failed items by document, without those on their way again."""
    out = failed if in_flight is None else failed.join(in_flight.select("id"), "id", "left_anti")
    return out.groupBy(document_of(F.col("id")).alias("doc_id")).agg(F.array_sort(F.collect_list("id")).alias("ids"))


def batch_fold(sizes: Column, batch_size: int) -> Column:
    """Batch number of each document of an array of sizes: a batch closes when it has batch_size items or more; a document is never split."""
    start = F.struct(F.lit(0).alias("batch"), F.lit(0).cast("long").alias("n"), F.expr("cast(array() as array<int>)").alias("out"))

    def step(acc: Column, size: Column) -> Column:
        full = acc["n"] + size >= batch_size
        return F.struct(F.when(full, acc["batch"] + 1).otherwise(acc["batch"]).alias("batch"), F.when(full, F.lit(0).cast("long")).otherwise(acc["n"] + size).alias("n"), F.concat(acc["out"], F.array(acc["batch"])).alias("out"))

    return F.aggregate(sizes, start, step, lambda acc: acc["out"])


def aligned_batches(docs: DataFrame, batch_size: int, lane: str = "lane") -> DataFrame:
    """(lane, doc_id, batch) of (lane, doc_id, size): each lane in id order by itself, one lane spread over many tasks.

    A batch closes when it has batch_size items or more; a document is never split.
    """
    return consecutive_batches(docs, batch_size, lane).withColumn("batch", F.col("batch").cast("int"))


def readiness(sent: DataFrame, log: DataFrame, accept_failures: bool = False, open_batches: DataFrame | None = None) -> DataFrame:
    """One row: items sent, settled, errored and pending, open batches, resolved (none pending, none open) and ready.

    Ready is what is resolved without errors; failures may be accepted, what is unresolved never.
    """
    last = log.groupBy("id").agg(F.max_by("status", "seq").alias("status"))
    all_ = sent.select("id").distinct().join(last, "id", "left")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    status = F.coalesce("status", F.lit("pending"))
    out = all_.agg(F.count(F.lit(1)).alias("items_sent"), n(status == SETTLED).alias("settled"), n(status == FAILED).alias("errored"), n(~status.isin(SETTLED, FAILED)).alias("pending"))
    unresolved = sent.sparkSession.createDataFrame([(0,)], "unresolved long") if open_batches is None else open_batches.agg(F.countDistinct("batch").alias("unresolved"))
    out = out.crossJoin(F.broadcast(unresolved))  # one row each
    resolved = (F.col("pending") == 0) & (F.col("unresolved") == 0)
    return out.withColumn("resolved", resolved).withColumn("ready", resolved & ((F.col("errored") == 0) | F.lit(accept_failures)))


def latest_batches(journal: DataFrame) -> DataFrame:
    """The last state of each batch of an event-sourced journal (batch, seq, state, n_items)."""
    w = Window.partitionBy("batch").orderBy(F.desc("seq"))
    return journal.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def batch_states(journal: DataFrame, items: DataFrame, log: DataFrame) -> DataFrame:
    """(batch, state, n_items, settled, errored): sending, sent, or settled once all items of a sent batch have a final status.

    journal: (batch, seq, state); items: (batch, id); log: statuses (batch, id, status, seq). Of a settled batch the counts are all that has to be kept.
    """
    last = latest_status(log).select("batch", "id", "status")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    per = items.select("batch", "id").distinct().join(last, ["batch", "id"], "left").groupBy("batch").agg(F.count(F.lit(1)).alias("n_items"), n(F.col("status") == SETTLED).alias("settled"), n(F.col("status") == FAILED).alias("errored"))
    out = latest_batches(journal).select("batch", "state").join(per, "batch", "left").na.fill(0, ["n_items", "settled", "errored"])
    final = (F.col("state") == "sent") & (F.col("settled") + F.col("errored") == F.col("n_items"))
    return out.withColumn("state", F.when(final, "settled").otherwise(F.col("state")))


def next_attempt(attempts: DataFrame, parts: DataFrame, key: str = "shard") -> DataFrame:
    """(key, attempt): the number of each part's next attempt, from 1."""
    last = attempts.groupBy(key).agg(F.max("attempt").alias("last"))
    return parts.select(key).distinct().join(last, key, "left").select(key, (F.coalesce("last", F.lit(0)) + 1).cast("int").alias("attempt"))
