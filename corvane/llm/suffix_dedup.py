"""Repeated passages by sparse suffix arrays.

Texts are read as words, letters A-Z lower-cased. Of all suffixes those at minimiser positions are kept: in each
window of WINDOW successive SEED-word strings, the one with the least hash. The choice depends on content alone,
so a passage of SEED + WINDOW - 1 words keeps the same suffixes wherever it stands. Suffixes whose first SEED
words stand nowhere else are dropped by their hash, the key. What is left is compared in one of two exact ways.

A key with up to CROWD rows: its suffixes are sorted by their words, and each is compared word by word with all
before it, to the right and to the left. Suffixes carry LEAST words to the right and WINDOW - 1 to the left.
Matches of LEAST words or more are joined to spans. That is enough: positions in a match are at most WINDOW
apart, each covers its surroundings, and together they cover the match however long it is.

A key with more rows: every string of LEAST words belongs to the minimiser of its first window. Those that belong
to the key's rows are named by the key and a second hash, counted, and marked where they stand more than once. No
row meets another one, so the work grows with the rows and not with their pairs, and a hot string is counted in
parts. Two strings are taken for one only if both 64-bit hashes are equal.

Defined results: null, empty and short texts have no spans; equal texts repeat each other as a whole; a passage
that repeats within one document counts; a null doc_id has spans; overlapping spans are one; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shelf, components, loosened, numbered, read
from .hashing import chunks, runs, words

LEAST, SEED, WINDOW = 50, 25, 26
#: Most rows of a key that are compared with each other.
CROWD = 32
#: Suffixes that a task holds at once.
MOST_SUFFIXES = 4096


def minimisers(texts: list[bytes], least: int = LEAST, seed: int = SEED, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """(text, word, hash, first, windows) of the minimiser positions of texts with at least least words: first is the
    first word of the first of so many successive windows that have this minimiser."""
    word, of, first = words(texts)
    if len(word) < least:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.astype(np.uint64), none, none
    at = np.arange(len(word) - seed + 1)
    grams = runs(word, at, at + seed, 0xD1342543DE82EF95, "words")
    fits = of[: len(word) - seed - window + 2] == of[seed + window - 2 :]  # the window's last word is of the same text
    view, found = np.lib.stride_tricks.sliding_window_view(grams, window), []
    for i in range(0, len(fits), 65_536):
        least_at = view[i : i + 65_536].argmin(axis=1) + np.arange(i, min(i + 65_536, len(fits)))
        found.append(least_at[fits[i : i + 65_536]])
    # minimisers ascend with their windows, so equal ones are successive
    at, at_first, windows = np.unique(np.concatenate(found), return_index=True, return_counts=True)
    before = first[of[at]]
    return of[at], at - before, grams[at], np.flatnonzero(fits)[at_first] - before, windows


def wholes(texts: list[bytes], of: np.ndarray, start: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Hashes of least words from word start of text of on. They must fit."""
    word, _, first = words(texts)
    at = first[of] + start
    return runs(word, at, at + least, 0xA0761D6478BD642F, "wholes")


def positions(docs: DataFrame, least: int = LEAST, seed: int = SEED, window: int = WINDOW) -> DataFrame:
    """(rid, word, key, first, windows) of (rid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = batch.column(0).to_numpy(zero_copy_only=False)
            texts = [(t.as_py() or "").encode() for t in batch.column(1)]
            for at, to in chunks(texts):
                of, word, key, first, windows = minimisers(texts[at:to], least, seed, window)
                columns = [rid[at + of], word.astype(np.int32), key.view(np.int64), first.astype(np.int32), windows.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["rid", "word", "key", "first", "windows"])

    return docs.select("rid", "text").mapInArrow(run, "rid long, word int, key long, first int, windows int")


def suffixes(docs: DataFrame, least: int = LEAST, window: int = WINDOW) -> DataFrame:
    """(key, suffix, left, rid, doc_id, word, whole) of (rid, doc_id, text, few, many).

    few, structs (word, key): the words from each position on, and those before it from right to left; whole is null.
    many, structs (first, windows, key): the hash of each string of least words; word is its first, suffix and left null.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["key", "suffix", "left", "rid", "doc_id", "word", "whole"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t.as_py() or "").encode() for t in batch.column(2)]
            part = batch.select([0, 1])
            suffix, left, row, at = [], [], [], 0
            few, ends = batch.column(3).flatten(), np.cumsum(batch.column(3).value_lengths().to_numpy(zero_copy_only=False))
            word, key = few.field("word").to_pylist(), few.field("key")

            def told(to: int) -> pa.RecordBatch:
                n = len(row)
                own = part.take(pa.array(row, pa.int64()))  # noqa: B023
                columns = [key.slice(to - n, n), pa.array(suffix, pa.binary()), pa.array(left, pa.binary()), *own.columns, pa.array(word[to - n : to], pa.int32()), pa.nulls(n, pa.int64())]  # noqa: B023
                for x in (suffix, left, row):  # noqa: B023
                    x.clear()
                return pa.RecordBatch.from_arrays(columns, names)

            for i, end in enumerate(ends.tolist()):
                own = texts[i].lower().split() if end > at else []
                for at in range(at, end):  # noqa: B020, PLR1704
                    p = word[at]
                    suffix.append(b" ".join(own[p : p + least]))
                    left.append(b" ".join(own[max(0, p - window + 1) : p][::-1]))
                    row.append(i)
                    if len(row) == MOST_SUFFIXES:
                        yield told(at + 1)
                at = end
            yield told(at)

            many, size = batch.column(4).flatten(), batch.column(4).value_lengths().to_numpy(zero_copy_only=False)
            first, windows, key = (many.field(x).to_numpy(zero_copy_only=False) for x in ("first", "windows", "key"))
            ends = np.cumsum(size)
            for a, b in chunks(texts):
                lo, hi = ends[a] - size[a], ends[b - 1]
                if lo == hi:
                    continue
                n = windows[lo:hi].astype(np.int64)
                start = np.repeat(first[lo:hi], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                of = np.repeat(np.repeat(np.arange(a, b), size[a:b]), n)
                length = np.array([len(t.split()) for t in texts[a:b]])
                fits = start + least <= length[of - a]
                start, of, keys = start[fits], of[fits], np.repeat(key[lo:hi], n)[fits]
                whole = wholes(texts[a:b], of - a, start, least).view(np.int64)
                none = pa.nulls(len(of), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), none, none, *part.take(pa.array(of)).columns, pa.array(start.astype(np.int32)), pa.array(whole)], names)

    return docs.select("rid", "doc_id", "text", "few", "many").mapInArrow(run, f"key long, suffix binary, left binary, rid long, doc_id {kind}, word int, whole long")


def shared(a: bytes, b: bytes) -> int:
    """Number of first words that are equal."""
    x, y = a.split(), b.split()
    if a == b:
        return len(x)
    n = 0
    for v, w in zip(x, y, strict=False):
        if v != w:
            break
        n += 1
    return n


def matches(rows: list[tuple], least: int = LEAST, seed: int = SEED, first: int = 0) -> Iterator[tuple]:
    """Marks (rid, doc_id, start, end, partner, other) of sorted rows (suffix, left, rid, doc_id, word); pairs have their second row from first on."""
    with_next = [shared(a[0], b[0]) for a, b in zip(rows, rows[1:], strict=False)]
    for i in range(first, len(rows)):
        right, row = least, rows[i]
        for j in range(i - 1, -1, -1):
            right = min(right, with_next[j])
            if right < seed:
                break
            other = rows[j]
            left = shared(row[1], other[1])
            if left + right >= least:
                yield row[2], row[3], row[4] - left, row[4] + right, other[3], other[2]
                yield other[2], other[3], other[4] - left, other[4] + right, row[3], row[2]
            if row[:2] == other[:2]:
                break  # the other row has met what this one would meet


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, seed: int = SEED, window: int = WINDOW, crowd: int = CROWD) -> DataFrame:
    """One row per row of docs with repeated passages: doc_id, n_spans, n_words, spans, partners, component_id.

    spans: array of (start, end) in words, end exclusive. partners: doc_ids that share a passage; of a crowded key's
    strings the first or the last document only. component_id: smallest doc_id reachable by shared passages.
    """
    if seed + window - 1 > least:
        raise ValueError("a window must fit into the least passage")
    spark = docs.sparkSession
    shelf = Shelf(spark, "suffix-dedup")
    own = numbered(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "rid")
    kept = shelf.keep(positions(own, least, seed, window), "positions")
    often = kept.groupBy("key").count().where("count > 1").select("key", (F.col("count") > crowd).alias("crowded"))
    kept = kept.join(loosened(often, "key"), "key")
    few, many = F.when(~F.col("crowded"), F.struct("word", "key")), F.when(F.col("crowded"), F.struct("first", "windows", "key"))
    kept = shelf.keep(kept.groupBy("rid").agg(F.collect_list(few).alias("few"), F.collect_list(many).alias("many")), "repeated")
    shelf.drop("positions")
    rows = shelf.keep(suffixes(own.join(kept, "rid"), least, window), "suffixes")
    kind = own.schema["doc_id"].dataType.simpleString()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: list[tuple] = []
        types = [pa.int64(), id_type, pa.int32(), pa.int32(), id_type, pa.int64()]
        for batch in batches:
            new = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            marks = list(matches(before + new, least, seed, first=len(before)))
            before = (before + new)[-crowd:]  # no key has more rows
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*marks, strict=True) if marks else [[]] * 6, types, strict=True)], ["rid", "doc_id", "start", "end", "partner", "other"])

    id_type = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())
    order = ["key", "suffix", "left", "rid", "word"]
    sorted_ = rows.where("whole is null").drop("whole").repartition("key").sortWithinPartitions(*order).select("suffix", "left", "rid", "doc_id", "word")
    met = shelf.keep(sorted_.mapInArrow(meet, f"rid long, doc_id {kind}, start int, end int, partner {kind}, other long"), "marks")

    strings = rows.where("whole is not null").select("key", "whole", "rid", "doc_id", "word")
    twice = strings.groupBy("key", "whole").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("low"), F.max("rid").alias("high"), F.min_by("doc_id", "rid").alias("low_id"), F.max_by("doc_id", "rid").alias("high_id"))
    twice = twice.where("n > 1").drop("n")
    is_low = F.col("rid") == F.col("low")
    partner, other = F.when(is_low, F.col("high_id")).otherwise(F.col("low_id")), F.when(is_low, F.col("high")).otherwise(F.col("low"))
    counted = strings.join(loosened(twice, "key", "whole"), ["key", "whole"]).select("rid", "doc_id", F.col("word").alias("start"), (F.col("word") + least).alias("end"), partner.alias("partner"), other.alias("other"))
    marks = shelf.keep(met.union(counted), "all-marks")
    linked = components(shelf, marks.select(F.col("rid").alias("a"), F.col("other").alias("b")))
    known = marks.select("rid", "doc_id").distinct().join(loosened(linked.withColumnRenamed("node", "rid"), "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    known = shelf.keep(known, "components")
    smallest = known.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    classes = known.join(loosened(smallest, "root"), "root").select("rid", "component_id")
    spans = marks.groupBy("rid", "doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("all"), F.array_sort(F.collect_set("partner")).alias("partners"))
    joined = F.aggregate(
        "all",
        F.expr("cast(array() as array<struct<start:int,end:int>>)"),
        lambda acc, s: F.when((F.size(acc) == 0) | (F.try_element_at(acc, F.lit(-1))["end"] < s["start"]), F.concat(acc, F.array(s))).otherwise(
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1))["end"], s["end"]).alias("end"))))
        ),
    )
    out = spans.withColumn("spans", joined).join(loosened(classes, "rid"), "rid")
    words = F.aggregate("spans", F.lit(0), lambda acc, s: acc + s["end"] - s["start"])
    return out.select("doc_id", F.size("spans").alias("n_spans"), words.alias("n_words"), "spans", "partners", "component_id")


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_passages(read(spark, sf_dir, "documents", ["doc_id", "text"]))
    told = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("doc_id", "n_spans", "n_words", told.alias("spans"), "partners", "component_id")
