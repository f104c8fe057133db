"""The ledger of an ingestion as two streams: items' statuses settle first, then the batches they came in.

The first stream is keyed by (batch, id), so a batch of any size spreads over all tasks. It keeps each item's last status
by seq and tells by how much a batch's counts change; rows that come again or too late change nothing. Items whose status is
final are forgotten once the watermark has passed by horizon: of them only the counts are left.

The second stream is keyed by batch and adds those changes up, a row a batch and epoch, beside the journal's states.
It tells each change of a batch's state: sending, sent, settled once all of its items have a final status, and stalled
when none of a sent batch's counts has changed for patience.

An epoch's rows are written to a folder of its own, which a repeated epoch replaces, so both ends are as of one run.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.ledger import FAILED, SETTLED

PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "batch string, n_items long, settled long, errored long, at timestamp"
STATES = "batch string, version long, state string, n_items long, settled long, errored long"


def _millis(at) -> int:
    return int(at.timestamp() * 1000)


class Items(StatefulProcessor):
    """By (batch, id): the last status, and what it changes in the batch's counts."""

    def __init__(self, horizon_ms: int):
        self.horizon = horizon_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "seq long, status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.last.get()
        seq, status = known or (None, None)
        new, latest = (seq, status), None
        for r in rows:
            latest = r.ts if latest is None or (r.ts and r.ts > latest) else latest
            if r.seq is not None and (new[0] is None or r.seq > new[0]):
                new = (r.seq, r.status)
        if known and new == (seq, status):
            return
        self.last.update((new[0], new[1]))
        # each call here is a trip to the JVM: only an item that has been final can have a timer
        if known and status in (SETTLED, FAILED):
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
        if new[1] in (SETTLED, FAILED) and latest is not None:
            self.handle.registerTimer(_millis(latest) + self.horizon)
        change = lambda s: int(new[1] == s) - int(known is not None and status == s)
        yield Row(batch=key[0], n_items=int(not known), settled=change(SETTLED), errored=change(FAILED), at=latest)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


class Batches(StatefulProcessor):
    """By batch: its counts and the journal's last state."""

    def __init__(self, patience_ms: int):
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.own = handle, handle.getValueState("own", "version long, seq long, journal string, state string, n_items long, settled long, errored long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        version, seq, journal, told, *counts = self.own.get() or (0, None, None, None, 0, 0, 0)
        before, latest = (told, *counts), None
        for r in rows:
            latest = r.at if latest is None or (r.at and r.at > latest) else latest
            if r.state is not None and (seq is None or r.seq > seq):
                seq, journal = r.seq, r.state
            counts = [a + (b or 0) for a, b in zip(counts, (r.n_items, r.settled, r.errored), strict=True)]
        state = "settled" if journal == "sent" and counts[1] + counts[2] == counts[0] else journal
        moved = (state, *counts) != before
        self.own.update((version + moved, seq, journal, state, *counts))
        if not moved:
            return
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if state == "sent" and latest is not None:
            self.handle.registerTimer(_millis(latest) + self.patience)
        yield Row(batch=key[0], version=version + 1, state=state, n_items=counts[0], settled=counts[1], errored=counts[2])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        version, seq, journal, _, *counts = self.own.get()
        self.own.update((version + 1, seq, journal, "stalled", *counts))
        yield Row(batch=key[0], version=version + 1, state="stalled", n_items=counts[0], settled=counts[1], errored=counts[2])

    def close(self) -> None:
        pass


def _run(rows: DataFrame, folder: str, checkpoint: str, combine=lambda df: df):
    def each(epoch: DataFrame, number: int) -> None:
        combine(epoch).write.mode("overwrite").parquet(f"{folder}/epoch={number}")

    conf = rows.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKS)  # a query takes the setting when it starts
    try:
        return rows.writeStream.foreachBatch(each).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.unset(PROVIDER) if before is None else conf.set(PROVIDER, before)


def settle_items(log: DataFrame, folder: str, delay: str = "1 day", horizon_ms: int = 7 * 86_400_000):
    """Starts the first stream over a status log (batch, id, status, seq, ts) and stops when all there is has been taken.

    Rows that come again within delay go before they reach a task's state; those older than the watermark are dropped.
    """
    rows = log.select(F.col("batch").cast("string").alias("batch"), "id", "status", F.col("seq").cast("long").alias("seq"), F.col("ts").cast("timestamp").alias("ts"))
    rows = rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["batch", "id", "status", "seq"])
    changes = rows.groupBy("batch", "id").transformWithState(Items(horizon_ms), CHANGES, "Append", "EventTime")
    sums = lambda df: df.groupBy("batch").agg(*[F.sum(c).alias(c) for c in ("n_items", "settled", "errored")], F.max("at").alias("at"))
    return _run(changes, f"{folder}/changes", f"{folder}/items-state", sums)


def settle_batches(spark: SparkSession, journal: DataFrame, folder: str, delay: str = "1 day", patience_ms: int = 86_400_000):
    """Starts the second stream over a streaming journal (batch, seq, state, ts) and the changes that the first one told in folder."""
    none = lambda kind: F.lit(None).cast(kind)
    changes = spark.readStream.schema(CHANGES).parquet(f"{folder}/changes/epoch=*").select(*[c.split()[0] for c in CHANGES.split(", ")], none("long").alias("seq"), none("string").alias("state"))
    states = journal.select(F.col("batch").cast("string").alias("batch"), *[none("long").alias(c) for c in ("n_items", "settled", "errored")], F.col("ts").cast("timestamp").alias("at"), F.col("seq").cast("long").alias("seq"), "state")
    rows = changes.unionByName(states).withWatermark("at", delay)
    return _run(rows.groupBy("batch").transformWithState(Batches(patience_ms), STATES, "Append", "EventTime"), f"{folder}/states", f"{folder}/batches-state")


def batch_states(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, state, n_items, settled, errored): the last that the second stream told of each batch that the journal knows."""
    told = spark.read.schema(STATES).parquet(f"{folder}/states/epoch=*")
    last = told.groupBy("batch").agg(F.max_by(F.struct("state", "n_items", "settled", "errored"), "version").alias("s"))
    return last.select("batch", "s.*").where("state is not null")
