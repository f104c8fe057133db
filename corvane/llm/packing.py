"""Best-fit packing of token pieces with large-item matching.

Items above a third of the capacity go at most two to a bin: greedy matching pairs each, from the largest down,
with the largest that still fits. Smaller items, from the largest down, best-fit the gaps that are left.

Lengths are integers up to the capacity, so the packing is computed for the histogram of lengths, not for the
items: runs of equal bins are packed at once, and the outcome is a table of runs (length, ranks, bins, place)
whose size depends on the capacity only. Each item looks its place up by its length and its rank among equals,
which distributed prefix sums give. The result is what packing all items one by one would give.

Defined results: a null text is an empty one, whose only token is the end; equal rows are separate items; equal
lengths are ranked by a hash of their document; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shelf, read, running_sum
from .tokens import encoder

CAPACITY, END = 4096, 1


class Runs:
    """Where items of a length go: ranks from first on fill bins from bin_ on, each items of them, from place on."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.next_rank: dict[int, int] = defaultdict(int)

    def put(self, length: int, count: int, bin_: int, each: int, place: int) -> None:
        self.rows.append((length, self.next_rank[length], bin_, each, place))
        self.next_rank[length] += count


class Gaps:
    """Runs of bins by the room they have left: a balanced search by a bit mask over the capacities."""

    def __init__(self) -> None:
        self.mask, self.runs = 0, defaultdict(list)

    def add(self, room: int, bin_: int, bins: int, place: int) -> None:
        if room > 0 and bins > 0:
            self.runs[room].append((bin_, bins, place))
            self.mask |= 1 << room

    def tightest(self, size: int) -> tuple[int, int, int, int] | None:
        """Takes out a run with the least room >= size."""
        above = self.mask >> size
        if not above:
            return None
        room = size + (above & -above).bit_length() - 1
        run = self.runs[room].pop()
        if not self.runs[room]:
            self.mask &= ~(1 << room)
        return room, *run


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs for so many items of each length, and the number of bins."""
    left, runs, gaps, bins = {k: v for k, v in histogram.items() if v}, Runs(), Gaps(), 0
    large = sorted((k for k in left if 3 * k > capacity), reverse=True)
    low = large[::-1]
    for a in large:
        while left[a]:
            # the largest partner that fits, itself included
            while low and not left[low[-1]]:
                low.pop()
            b = next((x for x in reversed(low) if x + a <= capacity and left[x] and (x != a or left[x] > 1)), None) if low and low[0] + a <= capacity else None
            if b is None:
                n = left[a]
                runs.put(a, n, bins, 1, 0)
                gaps.add(capacity - a, bins, n, a)
                left[a] = 0
            elif a == b:
                n = left[a] // 2
                runs.put(a, 2 * n, bins, 2, 0)
                gaps.add(capacity - 2 * a, bins, n, 2 * a)
                left[a] -= 2 * n
            else:
                n = min(left[a], left[b])
                runs.put(a, n, bins, 1, 0)
                runs.put(b, n, bins, 1, a)
                gaps.add(capacity - a - b, bins, n, a + b)
                left[a] -= n
                left[b] -= n
            bins += n
    for s in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while n := left[s]:
            found = gaps.tightest(s)
            if found is None:
                fit = capacity // s
                room, first, many, place = capacity, bins, -(-n // fit), 0
                bins += many
            else:
                room, first, many, place = found
            each = room // s
            whole = min(many, n // each)
            if whole:
                runs.put(s, whole * each, first, each, place)
                gaps.add(room - each * s, first, whole, place + each * s)
            rest = min(n - whole * each, each - 1) if whole < many else 0
            if rest:
                runs.put(s, rest, first + whole, rest, place)
                gaps.add(room - rest * s, first + whole, 1, place + rest * s)
            gaps.add(room, first + whole + bool(rest), many - whole - bool(rest), place)
            left[s] = n - whole * each - rest
    return runs.rows, bins


def pack(pieces: DataFrame, length: str, key, shelf: Shelf, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset. pieces: a written table of items of 1 to capacity tokens. key: a column of what tells items apart."""
    histogram = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}  # at most capacity rows
    rows, _ = plan(histogram, capacity)
    # a run's bins follow one another, so length and first rank order the table; a key of both finds an item's run
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    ranked = running_sum(pieces.withColumn("__one", F.lit(1)), [length], key, "__one", "__rank", rows_per_bucket=1024).drop("__one")
    start = {int(k): int(i) for i, k in reversed(list(enumerate(table[:, 0])))}
    stop = {int(k): int(i) + 1 for i, k in enumerate(table[:, 0])}
    sent = pieces.sparkSession.sparkContext.broadcast((table, start, stop))  # bounded by the capacity

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths, ranks):
        import pandas as pd

        table, start, stop = sent.value
        of, rank = lengths.to_numpy(), ranks.to_numpy()
        run = np.zeros(len(of), dtype=np.int64)
        for k in np.unique(of):
            at = of == k
            run[at] = start[int(k)] + np.searchsorted(table[start[int(k)] : stop[int(k)], 1], rank[at], side="right") - 1
        _, first, bin_, each, place_ = table[run].T
        nth = rank - first
        return pd.DataFrame({"sequence_id": bin_ + nth // each, "offset": place_ + nth % each * of})

    return ranked.withColumn("__at", place(F.col(length).cast("long"), F.col("__rank"))).withColumn("sequence_id", F.col("__at.sequence_id")).withColumn("offset", F.col("__at.offset")).drop("__at", "__rank")


def pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """Pieces of at most capacity tokens: doc_id, piece, start, length, ids_crc32, and ids (little-endian 32-bit) if asked for."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = encoder(path), np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(t.as_py() or "") + last
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    rows.append((d, i, at // 4, len(own) // 4, zlib.crc32(own), *([own] if with_ids else [])))
            types = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[i]) for i in range(len(names))], names)

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def pack_documents(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if asked for.

    path: the tokenizer's file, by default the public word tokenizer's.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    shelf = Shelf(docs.sparkSession, "packing")
    cut = shelf.keep(pieces(docs, path, doc_id, text, capacity, end, with_ids), "pieces")
    return pack(cut, "length", F.struct("doc_id", "piece", "ids_crc32"), shelf, capacity)


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents", ["doc_id", "text"]))
