"""How filters interact: what each removes, at each step of each order they can be applied in.

A document fails a set of filters, kept as a mask of bits, and all figures follow from how many documents of a part
have which mask; those counters add up, so parts of a corpus merge.

Whether a text repeats an earlier document's is found by sorting. Rows are dealt out in ranges of (fingerprint,
doc_id), so copies of one text spread over many tasks; a task sorts by fingerprint, whole text and doc_id and
compares each row with the one before it. A run of equal texts that a range's border cuts is settled by boundary
records, two a range as a rule: the text at each end and the least doc_id there. Their least doc_id by whole text
tells the first rows of the cut run whether a smaller one stands elsewhere.

Scale: whole texts are shuffled once, for the sort; the driver samples fingerprints and ids, no texts. A task holds one
text beside its sort. What follows are rows of a few bytes, counted before they are joined with labels; figures are
sums over counters.

Defined results: a null text is empty, and texts of no words fail A and pass B and C; equal texts are compared whole,
so fingerprints that collide change nothing; a null doc_id is larger than any other and equal to no other, so of null ids
none repeats another; rows with equal doc_id and text repeat each other no more than a row repeats itself; a null
part is the empty string; of several labels for a doc_id any 1 counts; a part without rows, and so an empty table,
has no figures; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, WORD, Shelf, loosened, read

LETTERS = "ABCDE"
REPEATED = "E"
THIN = "kind int, doc_id {id}, part string, mask int, repeated boolean, border int, run int, fingerprint long, text string"


def failures(text: Column) -> Column:
    """The mask of the filters that a text fails by itself: bit i for the i-th letter; E is not among them."""
    words = F.array_remove(F.split(text, f"[{SPACE}]+"), "")
    n = F.size(words)
    failed = {
        "A": n < 50,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 65 * n.cast("long"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 5 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }
    bits = [F.when(c, F.lit(1 << LETTERS.index(k))).otherwise(F.lit(0)) for k, c in failed.items()]
    return sum(bits[1:], bits[0])


def _differs(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Where a and b, with nulls equal to each other, differ."""
    same = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False)
    return ~(same | (a.is_null().to_numpy(zero_copy_only=False) & b.is_null().to_numpy(zero_copy_only=False)))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (border, fingerprint, doc_id, part, mask, text) of one range in order, to rows and boundary records without needless texts.

    border is the range's number. A row is open (it has a border and the number of a run) if only other ranges can
    tell whether it repeats a text: it has the least doc_id of its text here, and its fingerprint is the first here.
    """
    last = None  # the row before this batch
    first = start = None  # the range's first fingerprint; doc_id at which the current run began
    moved, run, ends = False, 0, []  # whether the run has gone on to a larger doc_id; runs of this fingerprint so far; their (run, text, least doc_id)
    edge: list[tuple] = []
    names = ["kind", "doc_id", "part", "mask", "repeated", "border", "run", "fingerprint", "text"]
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        border, prints, ids, part, mask, text = batch.columns
        at = border[0].as_py()
        before = [pa.concat_arrays([c.slice(0, 1) if last is None else last[i], c.slice(0, n - 1)]) for i, c in ((0, prints), (1, ids), (2, text))]
        new_print = _differs(prints, before[0])
        new_run = new_print | _differs(text, before[2])
        if last is None:
            first = prints[0].as_py()
            new_print[0] = new_run[0] = True
        steps = _differs(ids, before[1]) & ~new_run
        place = np.arange(n)
        began = np.maximum.accumulate(np.where(new_run, place, -1))  # -1: in an earlier batch
        moves = np.maximum.accumulate(np.where(steps, place, -1))
        repeated = (moves > began) | ((began < 0) & moved)
        leading = prints.to_numpy(zero_copy_only=False) == first
        number = np.full(n, -1)
        for i in np.flatnonzero(new_run):
            if new_print[i]:
                if ends and ends[0][3] == first:
                    edge += ends
                run, ends = 0, []
            ends.append((run, text.slice(i, 1), ids.slice(i, 1), prints[i].as_py(), at))
            number[i] = run
            run += 1
        number = number[np.maximum(began, 0)]
        if began[0] < 0:  # rows that go on with the run of the batch before
            number[began < 0] = start
        open_ = leading & ~repeated
        moved, start = bool(repeated[-1]), int(number[-1])
        last = [c.slice(n - 1, 1) for c in (prints, ids, text)]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.zeros(n, dtype=np.int32)), ids, part, mask, pa.array(repeated), pa.array(np.full(n, at, dtype=np.int32), mask=~open_), pa.array(number.astype(np.int32), mask=~open_),
            pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()),
        ], names)
    for r, t, i, p, at in edge + ends:
        own = pa.array([r if p == first else None], pa.int32())  # rows of the last fingerprint ask nobody, so their runs need no number
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), i, pa.nulls(1, pa.string()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.bool_()), pa.array([at], pa.int32()), own, pa.array([p], pa.int64()), t.cast(pa.string())], names)


def masks(docs: DataFrame, shelf: Shelf, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(doc_id, part, mask, n): how many documents have this id, part and mask of failed filters."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # the row's number only deals out rows with equal ids
    own = own.withColumn("fingerprint", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    ranges = own.repartitionByRange("fingerprint", F.col("doc_id").asc_nulls_last(), "place").sortWithinPartitions("fingerprint", "text", F.col("doc_id").asc_nulls_last())
    rows = ranges.select(F.spark_partition_id().alias("border"), "fingerprint", "doc_id", "part", failures(F.col("text")).alias("mask"), "text")
    thin = shelf.keep(rows.mapInArrow(_compare, THIN.format(id=own.schema["doc_id"].dataType.simpleString())), "compared")
    counted = thin.where("kind = 0").groupBy("doc_id", "part", "mask", "repeated", "border", "run").agg(F.count(F.lit(1)).alias("n"))
    edges = thin.where("kind = 1").select("border", "run", "fingerprint", "text", F.col("doc_id").alias("least"))
    least = edges.groupBy("fingerprint", "text").agg(F.min("least").alias("first"))
    told = edges.where("run is not null").join(least, ["fingerprint", "text"]).select("border", "run", (F.col("first").isNotNull() & (F.col("least").isNull() | (F.col("first") < F.col("least")))).alias("elsewhere"))
    told = counted.join(loosened(told, "border", "run"), ["border", "run"], "left")
    bit = F.when(F.col("repeated") | F.coalesce("elsewhere", F.lit(False)), 1 << LETTERS.index(REPEATED)).otherwise(0)
    return told.select("doc_id", "part", (F.col("mask") + bit).alias("mask"), "n")


def figures(counters: DataFrame) -> DataFrame:
    """The audit's rows of additive counters (part, mask, good, toxic, n).

    What a step removes depends on the set of filters before it alone, so figures are taken for each set and filter
    and then told for each order.
    """
    k = len(LETTERS)
    pairs = [(s, f) for f in range(k) for s in range(1 << k) if not s >> f & 1]
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("before"), F.lit(f).alias("filter")) for s, f in pairs])).alias("at")
    rows = counters.select("part", "mask", "good", "toxic", "n", each).select("part", "mask", "good", "toxic", "n", "at.*")
    bit = F.expr("shiftleft(1, filter)")
    fails, gone = F.col("mask").bitwiseAND(bit) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(F.lit(0))).cast("long")
    sets = rows.groupBy("part", "before", "filter").agg(
        total(~fails & ~gone).alias("kept"), total(fails & ~gone).alias("removed"), total(fails & gone).alias("redundant"), total(F.col("mask") == bit).alias("unique_fails"),
        total(fails & ~gone & F.col("good")).alias("good_lost"), total(fails & ~gone & F.col("toxic")).alias("toxic_lost"),
    )
    # how many orders apply exactly this set before this filter
    orders, times = [], {p: 0 for p in pairs}
    for order in permutations(range(k)):
        before = 0
        for step, f in enumerate(order):
            orders.append(("".join(LETTERS[i] for i in order), step + 1, before, f))
            times[before, f] += 1
            before |= 1 << f
    spark = counters.sparkSession
    weigh = spark.createDataFrame([(s, f, t) for (s, f), t in times.items()], "before int, filter int, times long")  # 80 rows
    shapley = sets.join(F.broadcast(weigh), ["before", "filter"]).groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("times")).alias("shapley"))
    steps = spark.createDataFrame(orders, "filter_order string, step int, before int, filter int")  # 600 rows
    return sets.join(shapley, ["part", "filter"]).join(F.broadcast(steps), ["before", "filter"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def counters(docs: DataFrame, labels: DataFrame, shelf: Shelf, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, good, toxic, n): documents by part, failed filters and labels. labels: doc_id, quality and toxic."""
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    marked = labels.groupBy(F.col(doc_id).alias("doc_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    rows = masks(docs, shelf, doc_id, text, part).join(loosened(marked, "doc_id"), "doc_id", "left")
    no = F.lit(False)
    return shelf.keep(rows.groupBy("part", "mask", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")).agg(F.sum("n").alias("n")), "counters")


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """A row for each part, order of the filters and step in it."""
    return figures(counters(docs, labels, Shelf(docs.sparkSession, "audit"), doc_id, text, part))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents", ["doc_id", "text", "source"]), read(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"]))


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
f AS (SELECT doc_id, part, CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), min(doc_id) OVER (PARTITION BY t) IS NOT NULL) THEN 16 ELSE 0 END AS mask FROM d),
m AS (SELECT part, mask, coalesce(good, FALSE) AS good, coalesce(bad, FALSE) AS bad FROM f LEFT JOIN
    (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id) USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (bad) AS x FROM m GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS b),
p AS (SELECT l1.l || l2.l || l3.l || l4.l || l5.l AS filter_order, [l1.b, l2.b, l3.b, l4.b, l5.b] AS bits FROM l l1, l l2, l l3, l l4, l l5 WHERE l1.b + l2.b + l3.b + l4.b + l5.b = 31
    AND l1.b | l2.b | l3.b | l4.b | l5.b = 31),
s AS (SELECT filter_order, step, bits[step] AS b, coalesce(list_sum(bits[:step - 1]), 0)::BIGINT AS before FROM p, (SELECT unnest([1, 2, 3, 4, 5])::INT AS step)),
r AS (SELECT part, filter_order, step, b, coalesce(sum(n) FILTER (mask & b = 0 AND mask & before = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & b <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & b <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = b), 0)::BIGINT AS unique_fails,
    coalesce(sum(g) FILTER (mask & b <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost, coalesce(sum(x) FILTER (mask & b <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
    FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, b))::BIGINT AS shapley FROM r"""
