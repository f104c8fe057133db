"""Orders over all rows without one task that holds them: ranges, row numbers and batches of consecutive rows."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.workspace import kept

PLACE_BITS = 33


def ranged(df: DataFrame, *order: str, name: str = "ranged") -> DataFrame:
    """df as a table with __part, the number of the range a row is in, and __place, its place there from 0; ranges ascend in order.

    Rows that are equal in order fall into one range, in any order.
    """
    out = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    out = out.withColumn("__part", F.shiftright("__id", PLACE_BITS).cast("int")).withColumn("__place", F.col("__id").bitwiseAND((1 << PLACE_BITS) - 1)).drop("__id")
    return kept(out, name)  # ranges are drawn anew whenever a plan is run


def row_numbers(df: DataFrame, *order: str, out: str = "ordinal", total: str | None = None) -> DataFrame:
    """df with each row's number from 0 in order, and the number of all rows as total if asked for.

    A range counts its rows, and the counts before it are added; the only order that takes one task is that of the ranges.
    """
    rows = ranged(df, *order)
    counts = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    counts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy()).alias("__total"))
    told = rows.join(F.broadcast(counts), "__part").withColumn(out, F.col("__before") + F.col("__place"))
    told = told if total is None else told.withColumn(total, F.col("__total"))
    return told.drop("__part", "__place", "__before", "__total")


def transfer(sizes: list[int], batch_size: int) -> list[tuple[int, int, int]]:
    """What a run of rows does to a batch that is open when it begins: (from, closed, left), ascending in from.

    An open batch of from items or more, up to the next entry's, leads to so many closed batches by the run's end and
    left items in the last one. While the run closes no batch at all, closed is 0 and left what it adds. There are at
    most as many entries as rows until the first batch closes, and one more.
    """
    n, sums = len(sizes), [0]
    for s in sizes:
        sums.append(sums[-1] + s)
    # from the end: how many batches close if one begins at row i, and what is left
    closed, left = [0] * (n + 1), [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        end = bisect_left(sums, sums[i] + batch_size, i + 1)
        closed[i], left[i] = (0, sums[n] - sums[i]) if end > n else (1 + closed[end], left[end])
    # an open batch of r items closes at the first row where r + sums reaches batch_size
    out = [(0, 0, sums[n])] if sums[n] < batch_size else []
    first = bisect_left(sums, batch_size, 1)
    for j in range(min(first, n), 0, -1):
        if sums[j] > sums[j - 1]:
            out.append((max(0, batch_size - sums[j]), 1 + closed[j], left[j]))
    return out


def applied(entries: list[tuple[int, int, int]], open_: int) -> tuple[int, int]:
    """(closed, left) for an open batch of so many items."""
    _, closed, left = entries[bisect_left(entries, (open_ + 1,)) - 1]
    return (closed, open_ + left) if not closed else (closed, left)


def consecutive_batches(docs: DataFrame, batch_size: int, lane: str = "lane", order: str = "doc_id", size: str = "size") -> DataFrame:
    """(lane, order, batch): rows of each lane in order fill batches from 0; one closes as soon as it has batch_size items.

    Rows are split into ranges of (lane, order), so a lane may spread over many tasks. Each range tells what it does
    to a batch of any size that is open when it begins; a lane's ranges are then followed in their order, a row each, and
    each range deals out its rows from what is open at its beginning. A range's sizes are held as numbers. A null size is 0.
    """
    if batch_size < 1:
        raise ValueError("a batch has one item at least")
    own = docs.select(F.col(lane).alias("__lane"), F.col(order).alias("__order"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("__size"))
    rows = ranged(own, "__lane", "__order", name="lanes")
    lanes, ids = (rows.schema[c].dataType.simpleString() for c in ("__lane", "__order"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """((lane, part), columns) for rows of one lane and range that follow each other."""
        for batch in batches:
            key = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            at = 0
            while at < len(key):
                to = at + 1
                while to < len(key) and key[to] == key[at]:
                    to += 1
                yield key[at], batch.slice(at, to - at)
                at = to

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sizes = None, []

        def out() -> pa.RecordBatch:
            e = transfer(sizes, batch_size)
            return pa.RecordBatch.from_arrays([pa.array([now[0]], kind), pa.array([now[1]], pa.int32()), pa.array([[list(x) for x in e]], pa.list_(pa.list_(pa.int64())))], ["lane", "part", "entries"])

        kind = None
        for key, part in runs(batches):
            kind = part.schema.field(0).type
            if key != now:
                if now is not None:
                    yield out()
                now, sizes = key, []
            sizes += part.column(2).to_pylist()
        if now is not None:
            yield out()

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun, batch_no, open_ = None, False, 0, 0
        for batch in batches:
            starts = []
            for own_lane, entries in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if own_lane != now or not begun:
                    now, begun, batch_no, open_ = own_lane, True, 0, 0
                starts.append((batch_no, open_))
                closed, open_ = applied([tuple(e) for e in entries], open_)
                batch_no += closed
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([s[i] for s in starts], pa.int64()) for i in (0, 1))], ["lane", "part", "batch", "open"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, n = None, 0, 0
        for key, part in runs(batches):
            numbers = []
            for start, open_, s in zip(part.column(4).to_pylist(), part.column(5).to_pylist(), part.column(2).to_pylist(), strict=True):
                if start is not None:  # what is open where the range begins, ahead of its rows
                    now, number, n = key, start, open_
                    continue
                assert key == now
                numbers.append(number)
                n += s
                if n >= batch_size:
                    number, n = number + 1, 0
            if numbers:
                told = part.slice(part.num_rows - len(numbers))
                yield pa.RecordBatch.from_arrays([told.column(0), told.column(3), pa.array(numbers, pa.int64())], [lane, order, "batch"])

    place = rows.select("__lane", "__part", "__size", "__place", "__order")
    sorted_ = place.repartition("__part").sortWithinPartitions("__part", "__place").select("__lane", "__part", "__size")
    told = sorted_.mapInArrow(tell, f"lane {lanes}, part int, entries array<array<long>>")
    starts = kept(told.repartition("lane").sortWithinPartitions("lane", "part").mapInArrow(follow, f"lane {lanes}, part int, batch long, open long"), "starts")
    none = F.lit(None).cast("long")
    heads = starts.select(F.col("lane").alias("__lane"), F.col("part").alias("__part"), F.lit(0).cast("long").alias("__size"), F.lit(None).cast(ids).alias("__order"), "batch", "open", F.lit(-1).cast("long").alias("__place"))
    both = heads.unionByName(place.select("__lane", "__part", "__size", "__order", none.alias("batch"), none.alias("open"), "__place"))
    # a lane's head comes before its rows: rows of one range are in the order of lanes already
    both = both.repartition("__part").sortWithinPartitions("__part", "__lane", "__place").select("__lane", "__part", "__size", "__order", "batch", "open")
    return both.mapInArrow(deal, f"{lane} {lanes}, {order} {ids}, batch long")
