"""Hard negatives by ball trees: for an anchor and each of its positives, rows of other labels whose score lies in a window under the positive's.

Rows are dealt evenly into units by a hash of their number, and every unit builds a ball tree. A node's ball bounds
the inner product of any of its rows with an anchor above and below: q.c +- |q| * radius. A search leaves out nodes
that lie outside the score window, nodes that hold no row of a fitting label, and nodes strictly beneath the k-th
best so far; ties with it are visited, as the smaller id decides. Anchors visit their most promising leaf first, each
its own, and then all other leaves that are not ruled out; a leaf meets its anchors in one matrix product.

A first pass finds the positives, a second one the negatives of all windows. Each unit tells its best k, and the best
of all units are the result.

Scale: anchors are a stated query set, which is sent to each unit in blocks; a unit's rows (at most MOST) are all that
a task holds beside a block of anchors. Arithmetic is on whole numbers in double precision where all products stay
exact, else on integers of any size. In 64 dimensions without clusters balls overlap and bounds rule out little, so a
search comes down to matrix products of anchors and units; exact search has no better bound there.

Defined results: rows with a null label or vector, or with null or non-finite components, take no part, neither as
anchors; a null vec_id is no anchor and comes last among ties; rows with equal vec_ids are rows of their own, so each is
an anchor if one is; vectors of different lengths never meet, and those without components score 0; scores beyond 64
bits saturate; further columns are ignored; an empty table has no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Shelf, loosened, numbered, read

#: Rows of a unit at least, where there are so many, and at most.
LEAST, MOST = 8192, 131_072
#: About so many units are made before units grow.
UNITS = 256
LEAF = 128
#: Anchors that a task searches for at once.
BATCH = 512
LOWEST, HIGHEST = -(2**63), 2**63 - 1
#: Whole numbers up to this are exact in double precision.
EXACT = 2**53


@dataclass
class Tree:
    """Nodes of a ball tree over rows x, in an order that makes each node a range of rows."""

    x: np.ndarray
    label: np.ndarray
    rank: np.ndarray  # a row's place in the order of ties
    row: np.ndarray  # its place in the unit as given
    start: np.ndarray
    end: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    low: np.ndarray  # least and greatest label
    high: np.ndarray
    children: list[tuple[int, int] | None]


def build(x: np.ndarray, label: np.ndarray, rank: np.ndarray, leaf: int = LEAF) -> Tree:
    """The tree of rows x (whole numbers as doubles). A node is halved along the line between two rows that lie far apart."""
    order = np.arange(len(x))
    start, end, center, radius, low, high, children = [], [], [], [], [], [], []
    todo = [(0, len(x), -1, 0)]
    while todo:
        a, b, parent, side = todo.pop()
        own = x[order[a:b]]
        c = own.mean(axis=0)
        away = np.sqrt(((own - c) ** 2).sum(axis=1))
        node = len(start)
        start.append(a), end.append(b), center.append(c), radius.append(away.max())
        labels = label[order[a:b]]
        low.append(labels.min()), high.append(labels.max()), children.append(None)
        if parent >= 0:
            children[parent] = (children[parent] or ()) + (node,)
        if b - a > leaf and away.max() > 0:
            one = own[away.argmax()]
            other = own[((own - one) ** 2).sum(axis=1).argmax()]
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition((own - one) @ (other - one), half)]
            todo += [(a + half, b, node, 1), (a, a + half, node, 0)]
    for a, b, kids in zip(start, end, children, strict=True):
        if kids is None:  # rows of a leaf by rank, so that the first of equal ones is the first by rank
            order[a:b] = order[a:b][np.argsort(rank[order[a:b]], kind="stable")]
    return Tree(x[order], label[order], rank[order], order, *map(np.array, (start, end, center, radius, low, high)), children)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers as 64-bit integers, exact; those beyond saturate."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1]) < EXACT:
        return (a @ b.T).astype(np.int64)
    exact = np.vectorize(int, otypes=[object])(a) @ np.vectorize(int, otypes=[object])(b).T
    return np.clip(exact, LOWEST, HIGHEST).astype(np.int64)


def search(tree: Tree, q: np.ndarray, label: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best k rows of each anchor and window: (scores, rows), rows as given and -1 where there are none.

    low and high: anchors x windows, of scores that fit. own: the row that is the anchor itself, or -1. same: whether
    rows fit whose label is the anchor's, or those whose label is not.
    """
    n, w = low.shape
    best, found = np.full((n, w, k), LOWEST), np.full((n, w, k), -1)
    ranks = np.full((n, w, k), HIGHEST)
    length = np.sqrt((q * q).sum(axis=1))
    # bounds as wide as rounding may make them
    middle = q @ tree.center.T
    reach = length[:, None] * tree.radius[None, :]
    slack = 1e-9 * (np.abs(middle) + reach + length[:, None] * np.sqrt((tree.center**2).sum(axis=1))[None, :]) + 1e-6
    upper, lower = middle + reach + slack, middle - reach - slack
    widest, tightest = high.max(axis=1), low.min(axis=1)
    inside = (tree.low[None, :] <= label[:, None]) & (label[:, None] <= tree.high[None, :]) if same else ~((tree.low == tree.high)[None, :] & (tree.low[None, :] == label[:, None]))
    inside &= (upper >= tightest[:, None].astype(float)) & (lower <= widest[:, None].astype(float)) & (tightest <= widest)[:, None]
    for node, kids in enumerate(tree.children):  # parents come before children
        for kid in kids or ():
            inside[:, kid] &= inside[:, node]
    leaves = np.array([i for i, kids in enumerate(tree.children) if kids is None])

    def visit(leaf: int, who: np.ndarray) -> None:
        a, b = tree.start[leaf], tree.end[leaf]
        s = products(q[who], tree.x[a:b])
        fits = (tree.label[None, a:b] == label[who, None]) == same
        fits &= tree.row[None, a:b] != own[who, None]
        for j in range(w):
            good = fits & (s >= low[who, j, None]) & (s <= high[who, j, None]) & ((s > best[who, j, -1:]) | ((s == best[who, j, -1:]) & (tree.rank[None, a:b] < ranks[who, j, -1:])))
            some = np.flatnonzero(good.any(axis=1))
            if not len(some):
                continue
            at = who[some]
            # a leaf has its first k rows at most to offer; a stable sort keeps them in order of rank
            mine, row = np.where(good[some], s[some], LOWEST), np.where(good[some], tree.row[None, a:b], -1)
            top = np.argsort(~mine, axis=1, kind="stable")[:, :k]  # ~ turns the order about without overflow
            score = np.concatenate([best[at, j], np.take_along_axis(mine, top, 1)], axis=1)
            row = np.concatenate([found[at, j], np.take_along_axis(row, top, 1)], axis=1)
            rank = np.concatenate([ranks[at, j], np.where(row[:, k:] >= 0, tree.rank[a:b][top], HIGHEST)], axis=1)
            by_rank = np.argsort(rank, axis=1, kind="stable")
            score, row, rank = (np.take_along_axis(v, by_rank, 1) for v in (score, row, rank))
            by_score = np.argsort(np.where(row >= 0, ~score, HIGHEST), axis=1, kind="stable")[:, :k]
            best[at, j], found[at, j], ranks[at, j] = (np.take_along_axis(v, by_score, 1) for v in (score, row, rank))

    first = np.where(inside[:, leaves], upper[:, leaves], -np.inf)
    promising = first.argmax(axis=1)
    started = np.isfinite(first[np.arange(n), promising]) if len(leaves) else np.zeros(n, dtype=bool)
    for i, leaf in enumerate(leaves):
        if len(who := np.flatnonzero(started & (promising == i))):
            visit(leaf, who)
    for i in np.argsort(-np.where(np.isfinite(first), first, 0).sum(axis=0), kind="stable"):
        leaf = leaves[i]
        worst = np.where(found[:, :, -1] >= 0, best[:, :, -1], LOWEST)  # the k-th best of each window
        open_ = (low <= high) & (upper[:, leaf, None] >= np.maximum(low, worst).astype(float)) & (lower[:, leaf, None] <= high.astype(float))
        if len(who := np.flatnonzero(inside[:, leaf] & ~(started & (promising == i)) & open_.any(axis=1))):
            visit(leaf, who)
    return best, found


def _matrix(column, n: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, len(flat) // n if n else 0)


def _matches(rows: DataFrame, anchors: DataFrame, same: bool, k: int, batch_rows: int, leaf: int) -> DataFrame:
    """(anchor, low, high, row, id, score): the best k of each unit for anchors (anchor, label, v, low array, high array) among rows (row, id, label, v)."""
    # how many units the vectors of a length have
    units = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    size = F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.floor(F.col("n") / UNITS)))
    units = units.select("d", F.ceil(F.col("n") / size).cast("int").alias("units"))
    none = F.lit(None).cast("array<long>")
    members = rows.join(loosened(units, "d"), F.size("v") == F.col("d")).select(
        F.struct("d", F.pmod(F.xxhash64("row"), F.col("units")).cast("int").alias("u")).alias("unit"), F.lit(0).alias("guest"), "row", "id", "label", "v", none.alias("low"), none.alias("high")
    )
    guests = anchors.join(loosened(units, "d"), F.size("v") == F.col("d")).select(
        F.explode(F.sequence(F.lit(0), F.col("units") - 1)).alias("u"), "d", F.col("anchor").alias("row"), F.lit(None).cast(rows.schema["id"].dataType).alias("id"), "label", "v", "low", "high"
    )
    guests = guests.select(F.struct("d", "u").alias("unit"), F.lit(1).alias("guest"), "row", "id", "label", "v", "low", "high")
    # members come in the order of ties, before the anchors that visit them
    dealt = members.union(guests).repartition("unit").sortWithinPartitions("unit", "guest", F.col("id").asc_nulls_last(), "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, members, guests, waiting = None, [], [], 0
        tree = numbers = ids = None

        def answers() -> Iterator[pa.RecordBatch]:
            nonlocal tree, numbers, ids, guests, waiting
            if not guests or not (members or tree is not None):
                guests, waiting = [], 0
                return
            if tree is None:
                table = pa.Table.from_batches(members).combine_chunks().to_batches()[0]
                n = table.num_rows
                numbers, ids = table.column(2).to_numpy(zero_copy_only=False), table.column(3)
                tree = build(_matrix(table.column(5), n), table.column(4).to_numpy(zero_copy_only=False), np.arange(n), leaf)
                members.clear()
            table = pa.Table.from_batches(guests).combine_chunks().to_batches()[0]
            guests, waiting = [], 0
            n = table.num_rows
            anchor = table.column(2).to_numpy(zero_copy_only=False)
            windows = table.column(6).value_lengths().to_numpy(zero_copy_only=False)
            w = int(windows.max())
            low, high = np.full((n, w), HIGHEST), np.full((n, w), LOWEST)
            taken = np.arange(w)[None, :] < windows[:, None]
            low[taken], high[taken] = (table.column(i).flatten().to_numpy(zero_copy_only=False) for i in (6, 7))
            order = np.argsort(numbers, kind="stable")
            place = order[np.minimum(np.searchsorted(numbers[order], anchor), len(order) - 1)]
            own = np.where(numbers[place] == anchor, place, -1)
            best, found = search(tree, _matrix(table.column(5), n), table.column(4).to_numpy(zero_copy_only=False), own, low, high, same, k)
            i, j, t = np.nonzero(found >= 0)
            row = found[i, j, t]
            yield pa.RecordBatch.from_arrays([pa.array(anchor[i]), pa.array(low[i, j]), pa.array(high[i, j]), pa.array(numbers[row]), ids.take(pa.array(row)), pa.array(best[i, j, t])], ["anchor", "low", "high", "row", "id", "score"])

        for batch in batches:
            at = batch.column(0).flatten()
            key = np.stack([c.to_numpy(zero_copy_only=False) for c in (*at, batch.column(1))], axis=1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1), len(key)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if tuple(key[a, :2]) != unit:
                    yield from answers()
                    unit, tree = tuple(key[a, :2]), None
                    members.clear()
                if key[a, 2] == 0:
                    members.append(batch.slice(a, b - a))
                    continue
                for c in range(a, b, batch_rows):
                    guests.append(batch.slice(c, min(batch_rows, b - c)))
                    waiting += guests[-1].num_rows
                    if waiting >= batch_rows:
                        yield from answers()
        yield from answers()

    id_type = rows.schema["id"].dataType.simpleString()
    return dealt.mapInArrow(run, f"anchor long, low long, high long, row long, id {id_type}, score long")


def _best(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first k of all units: by score, then id. rank counts from 1."""
    w = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: Column, shelf: Shelf, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100), batch: int = BATCH, leaf: int = LEAF) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (id, label, v), v of whole numbers.

    anchors: which rows are anchors. A negative's score is at least share (as a fraction) of the positive's and no
    more than it.
    """
    rows = shelf.keep(numbered(rows, "row"), "rows")
    own = rows.where(anchors).select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"), "label", "v")
    whole = [F.array(F.lit(v).cast("long")) for v in (LOWEST, HIGHEST)]
    found = _matches(rows, own.select("anchor", "label", "v", whole[0].alias("low"), whole[1].alias("high")), True, positives, batch, leaf)
    pairs = shelf.keep(_best(found, ["anchor"], positives).select("anchor", F.col("row").alias("positive"), F.col("id").alias("positive_id"), F.col("score").alias("high")), "positives")
    up, down = share
    # least whole number that is not under share of the positive's score, without products that overflow
    least = F.col("high") - F.expr(f"high div {down}") * (down - up) - F.floor(F.expr(f"high % {down}") * (down - up) / F.lit(down))
    pairs = pairs.withColumn("low", least.cast("long"))
    windows = pairs.where("low <= high").groupBy("anchor").agg(F.sort_array(F.collect_set(F.struct("low", "high"))).alias("w"))
    asked = own.join(loosened(windows, "anchor"), "anchor").select("anchor", "label", "v", F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    found = _best(_matches(rows, asked, False, negatives, batch, leaf), ["anchor", "low", "high"], negatives)
    told = pairs.join(found.select("anchor", "low", "high", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), ["anchor", "low", "high"])
    return told.join(own.select("anchor", "anchor_id"), "anchor").select("anchor_id", "positive_id", "rank", "negative_id", F.col("high").alias("positive_score"), "negative_score")


def whole_numbers(vectors: DataFrame, id_: str = "vec_id", label: Column | None = None, embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, label, v): rows that take part, with components as floor(scale * x)."""
    v, own = F.transform(F.col(embedding), lambda x: x.cast("double")), F.col("label") if label is None else label
    rows = vectors.select(F.col(id_).alias("id"), own.cast("long").alias("label"), v.alias("v")).where("label is not null and v is not null")
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return rows.select("id", "label", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(whole_numbers(vectors, label=label), F.col("id") % 100 == 0, Shelf(spark, "negatives"))


SQL = """
WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER w <= 5"""
