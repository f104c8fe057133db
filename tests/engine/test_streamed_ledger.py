"""The streamed ledger against the batch one, with repeated and late rows, restarts and timers."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from corvane.operators import ledger as batch
from corvane.streaming import ledger

LOG, JOURNAL = "batch string, id string, status string, seq long, ts timestamp", "batch string, seq long, state string, ts timestamp"
DAY = datetime(2024, 1, 1)


def written(spark, path, schema, files):
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def ran(spark, root, one_by_one=True):
    source = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1 if one_by_one else 1000).parquet(f"{root}/{name}")
    ledger.settle_items(source("log", LOG), f"{root}/out").awaitTermination()
    ledger.settle_batches(spark, source("journal", JOURNAL), f"{root}/out").awaitTermination()
    return {tuple(r) for r in ledger.batch_states(spark, f"{root}/out").collect()}


@pytest.mark.parametrize("seed", [1])
def test_repeated_and_late_rows_give_the_batch_result(spark, tmp_path, seed):
    r, root = random.Random(seed), str(tmp_path)
    log = [(f"b{r.randrange(4)}", f"i{r.randrange(12)}", r.choice(["pending", "completed", "errored"]), n, DAY + timedelta(minutes=n)) for n in range(120)]
    log += [("b5", "x", "completed", 500, DAY), ("b5", "y", "errored", 501, DAY), ("b6", "z", None, None, DAY)]
    journal = [(f"b{n}", 2 * n, "sending", DAY) for n in range(7)] + [(f"b{n}", 2 * n + 1, "sent", DAY) for n in range(7) if n != 3]
    shuffled = [*log, *r.sample(log, 40)]
    r.shuffle(shuffled)
    written(spark, f"{root}/log", LOG, [shuffled[:50], shuffled[50:110], shuffled[110:], log[:30]])
    written(spark, f"{root}/journal", JOURNAL, [journal[::-1], journal[:5]])
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    want = {tuple(x) for x in batch.batch_states(frame(journal, JOURNAL), frame(log, LOG), frame(log, LOG)).collect()}
    assert ran(spark, root) == want
    # more of both after a stop: the streams go on where they were
    more = [(f"b{n}", f"i{k}", "completed", 1000 + 12 * n + k, DAY + timedelta(hours=3)) for n in range(4) for k in range(12)]
    written(spark, f"{root}/log", LOG, [more, more[:9]])
    written(spark, f"{root}/journal", JOURNAL, [[("b3", 900, "sent", DAY)]])
    want = {tuple(x) for x in batch.batch_states(frame([*journal, ("b3", 900, "sent", DAY)], JOURNAL), frame(log + more, LOG), frame(log + more, LOG)).collect()}
    assert ran(spark, root, False) == want and {s for _, s, *_ in want} >= {"settled"}


def test_timers_compact_items_and_tell_stalled_batches(spark, tmp_path):
    root = str(tmp_path)
    written(spark, f"{root}/log", LOG, [[("a", "1", "completed", 1, DAY), ("b", "1", "pending", 2, DAY)]])
    written(spark, f"{root}/journal", JOURNAL, [[("a", 1, "sent", DAY), ("b", 1, "sent", DAY)]])
    assert ran(spark, root) == {("a", "settled", 1, 1, 0), ("b", "sent", 1, 0, 0)}
    later = DAY + timedelta(days=30)
    written(spark, f"{root}/log", LOG, [[("c", "1", "completed", 3, later)]])
    written(spark, f"{root}/journal", JOURNAL, [[("c", 1, "sent", later)]])
    assert ran(spark, root) == {("a", "settled", 1, 1, 0), ("b", "stalled", 1, 0, 0), ("c", "settled", 1, 1, 0)}
    # far behind the watermark: dropped, so a forgotten item does not count twice
    written(spark, f"{root}/log", LOG, [[("a", "1", "completed", 1, DAY), ("c", "2", "errored", 4, later)]])
    assert ran(spark, root) == {("a", "settled", 1, 1, 0), ("b", "stalled", 1, 0, 0), ("c", "settled", 2, 1, 1)}
    state = spark.read.format("statestore").option("path", f"{root}/out/items-state").option("operatorId", 0).option("stateVarName", "last").load()
    assert {tuple(k.key) for k in state.select("key").collect()} == {("b", "1"), ("c", "1"), ("c", "2")}  # a's item is gone


def test_an_item_that_was_never_final_asks_for_no_timers():
    from types import SimpleNamespace as Own

    class Handle:
        def __init__(self):
            self.own, self.asked, self.timers = None, 0, []

        def getValueState(self, name, schema):
            return Own(get=lambda: self.own, update=lambda v: setattr(self, "own", v), clear=lambda: setattr(self, "own", None))

        def listTimers(self):
            self.asked += 1
            return iter(self.timers)

        def deleteTimer(self, t):
            self.timers.remove(t)

        def registerTimer(self, t):
            self.timers.append(t)

    handle, items = Handle(), ledger.Items(1000)
    items.init(handle)
    tell = lambda seq, status: [(r.n_items, r.settled, r.errored) for r in items.handleInputRows(("b", "i"), iter([Own(seq=seq, status=status, ts=DAY)]), None)]
    assert tell(1, "pending") == [(1, 0, 0)] and tell(2, "completed") == [(0, 1, 0)]
    assert handle.asked == 0 and len(handle.timers) == 1
    assert tell(3, "pending") == [(0, -1, 0)] and handle.asked == 1 and handle.timers == []
