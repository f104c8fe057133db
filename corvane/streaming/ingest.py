"""Ingestion as a Structured Streaming job: documents in, items to a sink, each batch journaled before and after."""

from __future__ import annotations

import re
import time
from collections import deque
from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.identity import fingerprint
from ..operators.items import typed_items
from ..operators.ledger import FAILED, SETTLED
from ..plans.workspace import kept
from ..sources.corpus import keep_identity


class ItemSink(Protocol):
    """Where items go. send() must be idempotent: a batch may come again after a failure, with the same ids."""

    def send(self, items: DataFrame, batch: int) -> None: ...


class TableSink:
    """A local sink: a folder for each batch, replaced if the batch comes again. current() has an item's last version."""

    def __init__(self, path: str):
        self.path = path

    def send(self, items: DataFrame, batch: int) -> None:
        items.withColumn("sent_in", F.lit(batch)).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def current(self, spark: SparkSession) -> DataFrame:
        rows = spark.read.parquet(self.path).drop("batch")
        return rows.groupBy("id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "id"]), "sent_in").alias("v")).select("id", "v.*").drop("sent_in")


def start(docs: DataFrame, sink: ItemSink, checkpoint: str, journal: str | None = None, identity: dict | None = None, convert: Callable[[DataFrame], DataFrame] = typed_items):
    """Starts the job over a streaming frame of corpus rows and stops when all that is there has been taken.

    Offsets and batch ids are Spark's; the same batch id sends the same items again, so the end state is that of one send.
    """
    spark = docs.sparkSession
    if identity is not None:
        keep_identity(spark, checkpoint, identity)

    def each(batch: DataFrame, number: int) -> None:
        items = convert(batch)

        def note(state: str) -> None:
            if journal:
                spark.createDataFrame([(number, state)], "batch long, state string").coalesce(1).write.mode("overwrite").json(f"{journal}/batch={number}-{state}")

        note("sending")
        sink.send(items, number)
        note("sent")

    return docs.writeStream.foreachBatch(each).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start()


def run_identity(**parts) -> dict:
    return {k: v if isinstance(v, (str, int, float, bool, type(None))) else fingerprint(v) for k, v in parts.items()}


class Busy(Exception):
    """Raised by a sink whose service asks to wait; the message may say for how long."""


class Patient:
    """A sink that sends again when the one it wraps is busy: after the wait it asks for, else after wait seconds."""

    def __init__(self, sink: ItemSink, tries: int = 10, wait: float = 30.0, sleep: Callable[[float], None] = time.sleep):
        self.sink, self.tries, self.wait, self.sleep = sink, tries, wait, sleep

    def send(self, items: DataFrame, batch: int) -> None:
        for left in range(self.tries - 1, -1, -1):
            try:
                return self.sink.send(items, batch)
            except Busy as e:
                if not left:
                    raise
                asked = re.search(r"retry in (\d+) second", str(e), re.I)
                self.sleep(float(asked[1]) if asked else self.wait)


def latest_statuses(log: DataFrame) -> DataFrame:
    """The last status of each (batch, id) of a streaming log (batch, id, status, seq): one row of state a key."""
    return log.groupBy("batch", "id").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))


def dry_run(corpus: DataFrame, batch_size: int, lane: str = "source_type") -> DataFrame:
    """(lane, documents, items, batches) that a run would send; nothing is sent."""
    from ..operators.ledger import aligned_batches

    sizes = typed_items(corpus).groupBy("doc_id").agg(F.count(F.lit(1)).alias("size"))
    docs = corpus.select(lane, "doc_id").join(sizes, "doc_id")
    last = aligned_batches(docs, batch_size, lane).groupBy(lane).agg((F.max("batch") + 1).alias("batches"))
    return docs.groupBy(lane).agg(F.count(F.lit(1)).alias("documents"), F.sum("size").alias("items")).join(last, lane)


def settled(ask: Callable[[list[str]], dict[str, str]], ids: list[str], timeout: float = 3600.0, wait: float = 10.0, each: int = 500, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> dict[str, str]:
    """Status of each id of a batch, asked for again until it is final or the time is up; what is left is pending."""
    told, end = dict.fromkeys(ids, "pending"), clock() + timeout
    while left := [i for i, s in told.items() if s not in (SETTLED, FAILED)]:
        for at in range(0, len(left), each):
            told |= {i: s for i, s in ask(left[at : at + each]).items() if i in told and s in (SETTLED, FAILED)}
        if clock() >= end:
            break
        if any(s == "pending" for s in told.values()):
            sleep(wait)
    return told


def poll(sent: DataFrame, ask: Callable[[list[str]], dict[str, str]], **options) -> DataFrame:
    """(batch, id, status) of (batch, id): batches are polled in parallel, each as a whole; a batch is what was sent at once."""
    import pandas as pd

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        told = settled(ask, rows["id"].tolist(), **options)
        return pd.DataFrame({"batch": key[0], "id": list(told), "status": list(told.values())})

    return sent.groupBy("batch").applyInPandas(one, f"batch {sent.schema['batch'].dataType.simpleString()}, id string, status string")


class InFlight:
    """A sink that has window batches on their way at most: before another one is over, the oldest is waited for.

    Statuses of a batch are asked for by as many tasks as its ids have partitions and written to log as (id, status).
    finish() waits for what is left. Batches that an earlier process left open can be taken over with taken().
    """

    def __init__(self, sink: ItemSink, ask: Callable[[list[str]], dict[str, str]], log: str, window: int = 4, **options):
        self.sink, self.ask, self.log, self.window, self.options = sink, ask, log, window, options
        self.waiting: deque[tuple[int, DataFrame]] = deque()

    def taken(self, ids: DataFrame, batch: int) -> None:
        self.waiting.append((batch, kept(ids.select("id"), "in-flight")))
        while len(self.waiting) > self.window:
            self._settle()

    def send(self, items: DataFrame, batch: int) -> None:
        while len(self.waiting) >= self.window:
            self._settle()
        self.sink.send(items, batch)
        self.taken(items, batch)

    def _settle(self) -> None:
        import pandas as pd

        batch, ids = self.waiting[0]
        ask, options = self.ask, self.options

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                told = settled(ask, part["id"].tolist(), **options)
                yield pd.DataFrame({"id": list(told), "status": list(told.values())})

        ids.mapInPandas(run, "id string, status string").write.mode("overwrite").parquet(f"{self.log}/batch={batch}")
        self.waiting.popleft()

    def finish(self) -> None:
        while self.waiting:
            self._settle()


def wait_ready(status: Callable[[], dict], timeout: float = 900.0, wait: float = 20.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> dict:
    """The status of a store once it says that it takes items, itself or of its infra; a store that is not ready in time is an error."""
    end, last = clock() + timeout, {}
    while clock() < end:
        last = status()
        if last.get("ready_for_ingestion") or (last.get("infra") or {}).get("ready_for_ingestion"):
            return last
        sleep(wait)
    raise TimeoutError(f"not ready after {timeout} s: {last!r}")


def provision(spark: SparkSession, database: str) -> list[str]:
    """Makes the database if there is none, and lists its tables."""
    if not re.fullmatch(r"\w+", database):
        raise ValueError(f"no name of a database: {database!r}")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    return sorted(t.name for t in spark.catalog.listTables(database) if not t.isTemporary)
