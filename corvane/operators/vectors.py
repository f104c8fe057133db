"""Nearest vectors of a stated set of queries, in blocks.

Vectors are dealt evenly into units by a hash. A unit's vectors come in the order of their ids, before the queries that
visit it, and a task takes the products of a block of queries with one slice of the unit after another. Of each
query it keeps the best k so far and looks only at products that beat the k-th. The best of all units are the
result, so lists merge however vectors are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Vectors of a unit at least, where there are so many, and at most; about how many units there are in between.
LEAST, MOST, UNITS = 8192, 131_072, 256
#: Queries and vectors of one product.
QUERIES, SLICE = 512, 2048


def sound(vector: Column) -> Column:
    """Whether a vector has a direction: it is not null or zero, and no component is null or not finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    return vector.isNotNull() & F.exists(x, lambda v: v != 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))


def rounded(x: np.ndarray) -> np.ndarray:
    """To six places, halves away from zero, as SQL does."""
    return np.copysign(np.floor(np.abs(x) * 1e6 + 0.5), x) / 1e6 + 0.0


def best_of(units: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, places) of the k best rows of units for each of queries, both of length 1; equal scores by place, -1 where there are fewer."""
    score, place = np.full((len(queries), k), -np.inf), np.full((len(queries), k), -1)
    for at in range(0, len(units), SLICE):
        s = rounded(queries @ units[at : at + SLICE].T)
        who = np.flatnonzero((s > score[:, -1:]).any(axis=1))  # later rows lose a tie
        if not len(who):
            continue
        top = np.argsort(-s[who], axis=1, kind="stable")[:, :k]
        both = np.concatenate([score[who], np.take_along_axis(s[who], top, 1)], axis=1)
        at_ = np.concatenate([place[who], top + at], axis=1)
        order = np.argsort(-both, axis=1, kind="stable")[:, :k]
        score[who], place[who] = np.take_along_axis(both, order, 1), np.take_along_axis(at_, order, 1)
    return score, place


def _unit(column: pa.Array, n: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(question_id, doc_id, score, rank): the k vectors (doc_id, embedding) of largest cosine for each query (question_id, vector).

    Scores have six places, and equal ones go by doc_id. Vectors without a direction have no part in it, and those of
    other lengths than a query's are not near it.
    """
    rows = vectors.where(sound(F.col("embedding"))).select("doc_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    asked = queries.where(sound(F.col("vector"))).select("question_id", F.transform("vector", lambda x: x.cast("double")).alias("v"))
    n = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    each = F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.floor(F.col("n") / UNITS)))
    n = n.select("d", F.ceil(F.col("n") / each).cast("int").alias("units"))
    null = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    members = rows.join(n, F.size("v") == F.col("d")).select("d", F.pmod(F.xxhash64("doc_id"), F.col("units")).cast("int").alias("unit"), F.lit(0).alias("guest"), "doc_id", null(asked, "question_id"), "v")
    guests = asked.join(n, F.size("v") == F.col("d")).select("d", F.explode(F.sequence(F.lit(0), F.col("units") - 1)).alias("unit"), F.lit(1).alias("guest"), null(rows, "doc_id"), "question_id", "v")
    dealt = members.union(guests).repartition("d", "unit").sortWithinPartitions("d", "unit", "guest", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, guests, waiting, unit, ids = None, [], [], 0, None, None

        def answers() -> Iterator[pa.RecordBatch]:
            nonlocal guests, waiting, unit, ids
            if guests and members and unit is None:
                table = pa.Table.from_batches(members).combine_chunks()
                ids, unit = table.column(3).combine_chunks(), _unit(table.column(5).combine_chunks(), table.num_rows)
                members.clear()
            if guests and unit is not None:
                table = pa.Table.from_batches(guests).combine_chunks()
                score, place = best_of(unit, _unit(table.column(5).combine_chunks(), table.num_rows), k)
                q, j = np.nonzero(place >= 0)
                yield pa.RecordBatch.from_arrays([table.column(4).combine_chunks().take(pa.array(q)), ids.take(pa.array(place[q, j])), pa.array(score[q, j])], ["question_id", "doc_id", "score"])
            guests, waiting = [], 0

        for batch in batches:
            key = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1), len(key)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if tuple(key[a, :2]) != now:
                    yield from answers()
                    now, unit = tuple(key[a, :2]), None
                    members.clear()
                if key[a, 2] == 0:
                    members.append(batch.slice(a, b - a))
                    continue
                for c in range(a, b, QUERIES):
                    guests.append(batch.slice(c, min(QUERIES, b - c)))
                    waiting += guests[-1].num_rows
                    if waiting >= QUERIES:
                        yield from answers()
        yield from answers()

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    found = dealt.mapInArrow(run, f"question_id {kind(asked, 'question_id')}, doc_id {kind(rows, 'doc_id')}, score double")
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
