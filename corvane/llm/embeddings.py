"""Embedding near-duplicates by an exact metric range join.

Vectors are scaled to length 1, where cosine >= c means a distance of at most r = sqrt(2 - 2c). Pivots partition
them: a vector's home is the cell of its nearest pivot. A vector x with home i can only have a partner in cell j
if it lies within r of the border between the two (distance to the border: (x.pi - x.pj) / |pi - pj|, which the
triangle inequality bounds) and within r of the cell's farthest member; then it is replicated to j. Of two cells
one receives, chosen in a ring, so each pair meets once and cells share the load. Cells join independently.

Members within r/2 of their pivot form the cell's core. By the triangle inequality all of them are linked to each
other, so they are counted and connected in bulk and never meet. A cluster that a third of all vectors crowd into
costs no more than its members, as far as it lies in a core. What is not core meets all others of its cell.

Cells with many members are split into blocks of BLOCK, of core or other members; a task holds one block and streams
what may be near it, so its memory is bounded however large a cell is. Equal vectors count as one with a
multiplicity, so copies never meet. A block puts out counts for each vector and links that connect what is linked,
never all pairs.

Scale: pivots grow with the square root of the number of vectors. Where vectors fill all 64 dimensions evenly,
r of 0.45 reaches most borders and a vector goes to up to half the cells: exact range joins have no better bound
there. Where they cluster, few cells are reached.

Defined results: vectors that are null, empty or zero, or hold a null or non-finite component, link with nothing;
vectors of different lengths never link; equal rows are separate vectors that link; a null vec_id takes part but
never names a component that has another; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shelf, components, loosened, read

COSINE = 0.9
BLOCK = 2048
MOST_PIVOTS = 1024
#: Distances are widened by this, so that rounding never loses a pair that is exactly at the threshold; and a core is narrower by that.
SLACK, CORE_SLACK = 1e-9, 1e-6


def _scaled(values: np.ndarray) -> np.ndarray:
    """Rows at length 1. They are scaled by their largest component first, so that squares neither overflow nor vanish."""
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def _unit(column) -> np.ndarray:
    return _scaled(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1))


def farthest_first(sample: np.ndarray, k: int) -> np.ndarray:
    """k rows of sample, each as far from those before it as one can be."""
    chosen, near = [0], 1 - sample @ sample[0]
    while len(chosen) < min(k, len(sample)):
        i = int(near.argmax())
        if near[i] <= 0:
            break
        chosen.append(i)
        near = np.minimum(near, 1 - sample @ sample[i])
    return sample[chosen]


def receives(i: np.ndarray, j: np.ndarray, k: int) -> np.ndarray:
    """Whether cell j receives from cell i, of k cells: exactly one of two different cells receives from the other."""
    ahead = (j - i) % k
    return (ahead > 0) & ((2 * ahead < k) | ((2 * ahead == k) & (i < j)))


def _join(reps: DataFrame, shelf: Shelf, name: str, n: int, cosine: float, block: int) -> DataFrame:
    """(kind, x, y) for reps (node, mult, embedding) of one length: kind 0: node x has links to y vectors; 1: x and y are linked."""
    r = math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    k = max(1, min(MOST_PIVOTS, round(math.sqrt(n) / 4)))
    # bounded: eight candidates for each of at most MOST_PIVOTS pivots
    rows = reps.select("embedding", F.xxhash64("embedding").alias("h")).orderBy("h").limit(8 * k).collect()
    pivots = farthest_first(_scaled(np.array([x[0] for x in rows], dtype=np.float64)), k)
    k, spark = len(pivots), reps.sparkSession
    sent = spark.sparkContext.broadcast(pivots)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = _unit(batch.column(2)) @ sent.value.T
                home = near.argmax(axis=1)
                away = np.sqrt(np.maximum(0, 2 - 2 * near[np.arange(len(home)), home]))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int32)), pa.array(away)], ["node", "mult", "embedding", "home", "away"])

    kind = reps.schema["embedding"].dataType.simpleString()
    settled = shelf.keep(reps.select("node", "mult", "embedding").mapInArrow(settle, f"node long, mult long, embedding {kind}, home int, away double"), f"{name}-settled")
    core = r / 2 - CORE_SLACK
    count, cored, radius = np.zeros(k, dtype=np.int64), np.zeros(k, dtype=np.int64), np.zeros(k)
    inside = F.col("away") <= core
    for h, c, d, a in settled.groupBy("home").agg(F.count(F.lit(1)), F.sum(inside.cast("long")), F.max("away")).collect():  # a row for each pivot
        count[h], cored[h], radius[h] = c, d, a
    # a small cell is one block; a larger one has blocks of core and of other members, these first
    whole = count <= block
    loose, tight = np.where(whole, 0, -(-(count - cored) // block)), np.where(whole, 1, -(-cored // block))
    blocks = loose + tight
    first = np.concatenate([[0], np.cumsum(blocks)])  # number of a cell's first block
    shape = spark.sparkContext.broadcast((count, radius, whole, loose, tight, first))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, (count, radius, whole, loose, tight, first) = sent.value, shape.value
        blocks = loose + tight
        between = np.sqrt(np.maximum(1e-18, 2 - 2 * pivots @ pivots.T))
        cells = np.arange(k)
        for batch in batches:
            home = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            node = batch.column(0).to_numpy(zero_copy_only=False)
            near = _unit(batch.column(2)) @ pivots.T
            gap = near[np.arange(len(home)), home][:, None] - near
            reach = (gap <= (r * between)[home]) & (np.sqrt(np.maximum(0, 2 - 2 * near)) <= radius[None, :] + r) & (count > 0)[None, :]
            reach &= receives(home[:, None], cells[None, :], k)
            # a block of the home by a mixed hash of the node; who is not core also goes to the home's later blocks
            mixed = (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            central = batch.column(4).to_numpy(zero_copy_only=False) <= core
            later_on = central | whole[home]  # their block is among those that come last, and they visit none of their home
            many = np.where(later_on, tight[home], loose[home])
            own = (mixed % many.astype(np.uint64)).astype(np.int64) + np.where(later_on, loose[home], 0)
            row, unit, guest = [np.arange(len(home))], [first[home] + own], [np.where(central, CORE, MEMBER)]
            for j in range(int(blocks.max())):
                at, cell = np.nonzero(reach & (blocks > j)[None, :])
                later = np.nonzero(~later_on & (j > own) & (j < blocks[home]))[0]
                row += [at, later]
                unit += [first[cell] + j, first[home[later]] + j]
                guest += [np.full(len(at) + len(later), GUEST)]
            row, unit, guest = map(np.concatenate, (row, unit, guest))
            for at in range(0, len(row), 20_000):
                part = row[at : at + 20_000]
                taken = batch.select([0, 1, 2]).take(pa.array(part))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(unit[at : at + 20_000]), pa.array(guest[at : at + 20_000].astype(np.int32))], ["node", "mult", "embedding", "unit", "guest"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, members, told = None, None, []

        def out() -> pa.RecordBatch:
            rows = np.concatenate(told) if told else np.zeros((0, 3), dtype=np.int64)
            told.clear()
            return pa.RecordBatch.from_arrays([pa.array(rows[:, i]) for i in range(3)], ["kind", "x", "y"])

        for batch in batches:
            units = batch.column(3).to_numpy(zero_copy_only=False)
            guests = batch.column(4).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((units[1:] != units[:-1]) | (guests[1:] != guests[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(units)], strict=True):
                if a == b:
                    continue
                if units[a] != unit:
                    if members is not None:
                        told.append(members.counted())
                    unit, members = units[a], _Members(cosine)
                part = batch.slice(a, b - a)
                node, mult = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                unit_ = _unit(part.column(2))
                told.extend(members.meet(node, mult, unit_) if guests[a] == GUEST else members.add(node, mult, unit_, guests[a] == CORE))
            yield out()
        if members is not None:
            told.append(members.counted())
        yield out()

    dealt = settled.mapInArrow(deal, f"node long, mult long, embedding {kind}, unit long, guest int")
    met = dealt.repartition("unit").sortWithinPartitions("unit", "guest").mapInArrow(meet, "kind long, x long, y long")
    cores = settled.where(inside).groupBy("home").agg(F.sum("mult").alias("all"), F.min("node").alias("one"))
    cores = settled.where(inside).select("node", "mult", "home").join(F.broadcast(cores), "home")  # a row for each pivot at most
    bulk = cores.where("all > mult").select(F.lit(0).cast("long"), "node", F.col("all") - F.col("mult")).union(cores.where("node <> one").select(F.lit(1).cast("long"), "node", "one"))
    return met.union(bulk)


#: What a vector is to a block, in the order in which a block takes them.
MEMBER, CORE, GUEST = 0, 1, 2


class _Members:
    """A block's members: what has been linked to them so far, and which of them are connected."""

    STEP = 1024

    def __init__(self, cosine: float):
        self.cosine = cosine
        self.node, self.mult, self.links, self.root = (np.zeros(0, dtype=np.int64) for _ in range(4))
        self.unit: np.ndarray | None = None
        self.loose, self.first_core = 0, -1  # how many members are no core's, and the first that is

    def add(self, node, mult, unit, core: bool = False) -> list[np.ndarray]:
        """More members; they meet those before them and each other. A core's come last and meet no others of it: these are linked as they are."""
        told = self.meet(node, mult, unit, self.loose) if self.loose else []
        at = len(self.node)
        if core and self.first_core < 0:
            self.first_core = at
        self.loose += 0 if core else len(node)
        self.unit = unit if self.unit is None else np.concatenate([self.unit, unit])
        self.node, self.mult = np.concatenate([self.node, node]), np.concatenate([self.mult, mult])
        self.links = np.concatenate([self.links, np.zeros(len(node), dtype=np.int64)])
        fresh = np.arange(at, at + len(node))
        if core:
            fresh[:] = self.first_core if at == self.first_core else self.root[self.first_core]
        self.root = np.concatenate([self.root, fresh])
        for i in range(0, 0 if core else len(node), self.STEP):
            own = slice(at + i, min(at + i + self.STEP, at + len(node)))
            near = self.unit[own] @ self.unit[at:].T >= self.cosine
            near[np.arange(own.stop - own.start), np.arange(own.start - at, own.stop - at)] = False
            self.links[own] += near @ self.mult[at:]
            for x in np.flatnonzero(near.any(axis=1)):
                told += self._connect(self.node[own.start + x], np.flatnonzero(near[x]) + at, own.start + x)
        return told

    def meet(self, node, mult, unit, first: int | None = None) -> list[np.ndarray]:
        """What node and the first members are to each other; all members if first is None."""
        told = []
        for i in range(0, len(node), self.STEP):
            near = unit[i : i + self.STEP] @ self.unit[:first].T >= self.cosine
            rows = np.flatnonzero(near.any(axis=1))
            if len(rows):
                near = near[rows]
                self.links[:first] += mult[i + rows] @ near
                told.append(np.stack([np.zeros(len(rows), dtype=np.int64), node[i + rows], near @ self.mult[:first]], axis=1))
                for x, hits in zip(rows, near, strict=True):
                    told += self._connect(node[i + x], np.flatnonzero(hits))
        return told

    def _connect(self, node: int, hits: np.ndarray, own: int | None = None) -> list[np.ndarray]:
        """Links node to one member of each connected part among hits."""
        roots = np.unique(self.root[hits])
        if own is not None:
            if len(roots) == 1 and roots[0] == self.root[own]:
                return []
            roots = roots[roots != self.root[own]]
        told = np.stack([np.ones(len(roots), dtype=np.int64), np.full(len(roots), node), self.node[roots]], axis=1)
        joined = roots if own is None else np.append(roots, self.root[own])
        if len(joined) > 1:
            self.root[np.isin(self.root, joined)] = joined.min()
        return [told]

    def counted(self) -> np.ndarray:
        some = self.links > 0
        return np.stack([np.zeros(int(some.sum()), dtype=np.int64), self.node[some], self.links[some]], axis=1)


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    shelf = Shelf(spark, "embeddings")
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    e = F.col(embedding)
    valid = e.isNotNull() & (F.size(e) > 0) & F.forall(e, fine) & F.exists(e, lambda v: v != 0)
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.when(valid, e).alias("embedding")).withColumn("rid", F.monotonically_increasing_id())
    rows = shelf.keep(rows, "rows")
    reps = rows.where("embedding is not null").groupBy("embedding").agg(F.min("rid").alias("node"), F.count(F.lit(1)).alias("mult"), F.min("vec_id").alias("first"))
    reps = shelf.keep(reps, "reps")
    told = None
    for length, n in sorted(reps.groupBy(F.size("embedding")).count().collect()):
        part = shelf.keep(_join(reps.where(F.size("embedding") == length), shelf, f"d{length}", n, cosine, block), f"d{length}-told")
        told = part if told is None else told.union(part)
    if told is None:
        told = spark.createDataFrame([], "kind long, x long, y long")
    counts = told.where("kind = 0").groupBy(F.col("x").alias("node")).agg(F.sum("y").alias("n"))
    linked = components(shelf, told.where("kind = 1").select(F.col("x").alias("a"), F.col("y").alias("b")))
    rooted = reps.join(linked, "node", "left").join(counts, "node", "left")
    rooted = rooted.select("node", "first", "embedding", F.coalesce("root", "node").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
    rooted = shelf.keep(rooted, "rooted")
    firsts = loosened(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root")
    found = loosened(rooted.join(firsts, "root").select("embedding", "n_links", "component_id"), "embedding")
    out = rows.where("embedding is not null").join(found, "embedding").select("vec_id", "n_links", "component_id")
    out = out.union(rows.where("embedding is null").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings", ["vec_id", "embedding"]))
