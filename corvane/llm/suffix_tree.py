"""Language-model scoring by a probabilistic suffix tree over words.

A context is up to DEPTH words before a token. It is retained if it stands LEAST times or more in the training texts
and its next-token distribution diverges from its suffix's: the log-likelihood ratio of the two over all its
occurrences must be GAIN bits for each of its distinct next tokens, as each costs a parameter. The test uses counts
alone, so more text retains more and longer contexts and nothing bounds their number. A token is scored in the state
of its longest retained suffix. Distributions are smoothed by absolute discounting towards the next shorter retained
suffix and last towards word frequencies, with one further word for all unseen ones.

No task and no driver holds the tree. Texts become chunks of about CHUNK tokens, written once as small integers. For
each chunk the hashes of its distinct strings of 1 to DEPTH + 1 words go to ranges of hashes, sorted and compressed,
are summed there, and the sums return to the chunks that sent them, the first of which to learn from the string owns it. A chunk then knows
n(context) and n(context, next) for each of its positions, and sends what the strings it owns add to the ratio and to the
number of distinct next tokens of their contexts the same way. Each string adds once, by its counts alone, so the model is
the same however texts are dealt into files and chunks. What comes back is which contexts are retained. A string that
stands a million times in a chunk is one entry, so a hot one has no more than an entry a chunk.

Words are told apart by 64 bits, longer strings by SPARE bits more than the number of tokens needs: at any size about
one in 2^SPARE takes another's count, and what such a string adds may depend on chunks.

Scale: texts are read once. What moves grows in proportion to the tokens; the driver receives a few counts.

Defined results: a null text counts as empty, and an empty text is one end; a null doc_id trains and is not held
out; equal rows count each; a text over CHUNK tokens spans chunks; without training rows every token scores 0; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing
from .common import Shelf, read

DEPTH = 2
LEAST = 2
GAIN = 4.0
DISCOUNT = 0.75
SPARE = 16
#: Tokens of a chunk; entries of a range of hashes.
CHUNK, ENTRIES = 3 << 18, 2_000_000
START, END = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA3B195354A39B70D))
STEP = np.uint64(0xD1342543DE82EF95)
#: Fractions of a bit in which a string's part of a ratio is taken.
BIT = 1 << 4


def chunked(docs: DataFrame, depth: int, size: int = CHUNK) -> DataFrame:
    """(chunk, docs, vocab, stream, n, trained) of (rid, doc_id, trains, text).

    A document in a chunk is its tokens, after depth tokens before them that count elsewhere or are starts. vocab:
    hashes of the chunk's words, the frequent ones first. n: tokens, trained: those that are learned from.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number = TaskContext.get().partitionId() << 32, 0
        held: list[tuple] = []
        holds, id_type = 0, None

        def told() -> pa.RecordBatch:
            nonlocal number, holds
            rid, doc_id, trains, tokens = zip(*held, strict=True)
            vocab, ids, n = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            lengths = np.array([len(t) - depth for t in tokens])
            parts = pa.StructArray.from_arrays([pa.array(rid, pa.int64()), pa.array(doc_id, id_type), pa.array(trains, pa.bool_()), pa.array(lengths, pa.int32())], ["rid", "doc_id", "trains", "size"])
            row = [pa.array([first + number]), pa.ListArray.from_arrays(pa.array([0, len(parts)], pa.int32()), parts), pa.array([hashing.packed(vocab[order])]), pa.array([hashing.packed(place[ids])]), pa.array([int(lengths.sum())]), pa.array([int(lengths[np.array(trains)].sum())])]
            held.clear()
            number, holds = number + 1, 0
            return pa.RecordBatch.from_arrays(row, ["chunk", "docs", "vocab", "stream", "n", "trained"])

        for batch in batches:
            id_type = batch.schema.field(1).type
            texts = [(t.as_py() or "").encode() for t in batch.column(3)]
            rid, doc_id, trains = (batch.column(i).to_pylist() for i in range(3))
            for a, b in hashing.chunks(texts):
                word, _, begins = hashing.words(texts[a:b])
                for i, own in zip(range(a, b), np.split(word, begins[1:]), strict=True):
                    own = np.concatenate([np.full(depth, START), own, [END]])
                    for at in range(0, len(own) - depth, size):
                        held.append((rid[i], doc_id[i], trains[i], own[at : at + size + depth]))
                        holds += min(size, len(own) - depth - at)
                        if holds >= size:
                            yield told()
        if held:
            yield told()

    return docs.select("rid", "doc_id", "trains", "text").mapInArrow(run, f"chunk long, docs array<struct<rid:long,doc_id:{kind},trains:boolean,size:int>>, vocab binary, stream binary, n long, trained long")


class Chunk:
    """A chunk's distinct strings of each length (keys), which of them each place has (at), and how often they are learned (own)."""

    def __init__(self, vocab: bytes, stream: bytes, sizes: np.ndarray, trains: np.ndarray, depth: int, bits: int):
        words, ids = hashing.unpacked(vocab), hashing.unpacked(stream).astype(np.int64)
        h = words[ids]
        self.begin = np.concatenate([[0], np.cumsum(sizes + depth)])[:-1]
        self.token = np.ones(len(h), dtype=bool)  # a token to score, not one before the document's part
        for i in range(depth):
            self.token[self.begin + i] = False
        self.learned = self.token & np.repeat(trains, sizes + depth)
        counted = self.learned.copy()  # a start counts once a document, as the context of its first token
        last = self.begin[trains] + depth - 1
        counted[last[h[last] == START]] = True
        order = np.argsort(words)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.keys, self.at, self.where = [words[order]], [place[ids]], [np.zeros(len(words), dtype=np.int64)]
        for _ in range(depth):
            h = hashing.mixed(np.concatenate([h[:1], h[:-1]]) * STEP + words[ids])
            key, where, at = np.unique(h >> np.uint64(64 - bits), return_index=True, return_inverse=True)
            self.keys.append(key)
            self.at.append(at)
            self.where.append(where)  # a place of each string
        self.own = [np.bincount(a, weights=counted, minlength=len(k)) for k, a in zip(self.keys, self.at, strict=True)]

    def context(self, length: int) -> np.ndarray:
        """For each place the string of so many words before it; of use at tokens only."""
        return np.concatenate([self.at[length - 1][:1], self.at[length - 1][:-1]])


    def divergence(self, totals: list[np.ndarray], owned: np.ndarray, j: int, positions: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(asked, next tokens, bits) of the contexts of j words: which are asked for, and what the strings that this chunk owns add to them.

        A string's part of the ratio is taken once, over all its occurrences, and rounded by itself: sums are the same
        however texts are dealt into chunks.
        """
        where = self.where[j][owned & (totals[j] > 0)]
        where = where[self.keys[0][self.at[0][where]] != START]  # a start follows nothing
        before = np.maximum(where - 1, 0)
        # a string that took another's count may have parts without any
        real = (totals[j - 1][self.at[j - 1][before]] > 0) & (totals[j - 1][self.at[j - 1][where]] > 0)
        real &= (j == 1) | (totals[max(j - 2, 0)][self.at[max(j - 2, 0)][before]] > 0)
        where, before = where[real], before[real]
        context, string, n = self.at[j - 1][before], self.at[j][where], len(self.keys[j - 1])
        above = positions if j == 1 else totals[j - 2][self.at[j - 2][before]]
        both = totals[j][string]
        bits = np.rint(both * np.log2(both / totals[j - 1][context] * above / totals[j - 1][self.at[j - 1][where]]) * BIT)
        asked = (np.bincount(self.context(j)[self.token], minlength=n) > 0) | (np.bincount(context, minlength=n) > 0)
        asked &= totals[j - 1] >= least
        return asked, np.bincount(context, minlength=n), np.bincount(context, weights=bits, minlength=n)


class Counts:
    """What is known of a chunk's places: n of the context, of the context with the token, by length; 0: no context."""

    def __init__(self, own: Chunk, totals: list[np.ndarray], positions: int):
        self.context = [np.full(len(own.token), positions, dtype=np.int64)]
        self.both = [totals[0][own.at[0]]]
        for j in range(1, len(totals)):
            self.context.append(totals[j - 1][own.context(j)])
            self.both.append(totals[j][own.at[j]])


def _edges(bits: int, ranges: int) -> np.ndarray:
    return np.array([-(-(i << bits) // ranges) for i in range(1, ranges)], dtype=np.uint64)


def _sent(chunk: int, level: int, bits: int, ranges: int, keys: np.ndarray, values: list[np.ndarray]) -> Iterator[tuple]:
    """(range, chunk, keys, values) of sorted keys; ranges of different levels differ."""
    cuts = np.concatenate([[0], np.searchsorted(keys, _edges(bits, ranges)), [len(keys)]])
    for i in np.flatnonzero(np.diff(cuts)):
        a, b = cuts[i], cuts[i + 1]
        yield level << 40 | int(i), chunk, hashing.packed(np.diff(keys[a:b], prepend=np.uint64(0))), [hashing.packed(hashing.signed(v[a:b])) for v in values]


SENT = "range long, chunk long, keys binary, values array<binary>"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary())), strict=True)], ["range", "chunk", "keys", "values"])


def summed(sent: DataFrame, answer: Callable[[list[np.ndarray]], np.ndarray], ranges: int) -> DataFrame:
    """(range, chunk, answer, distinct) of SENT rows: for each key that a row holds, twice the answer of the key's summed values.

    One is added for the first chunk with a first value over 0, which owns the key. distinct: how many keys of the range have a first
    sum over 0, told once a range.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def told() -> pa.RecordBatch:
            keys = [np.cumsum(hashing.unpacked(k), dtype=np.uint64) for _, k, _ in held]
            sizes = [len(k) for k in keys]
            _, at = np.unique(np.concatenate(keys), return_inverse=True)
            parts = [np.concatenate([hashing.unsigned(hashing.unpacked(v[i])) for *_, v in held]) for i in range(len(held[0][2]))]
            sums = []
            for p in parts:  # exact: in integers
                total = np.zeros(int(at.max()) + 1, dtype=np.int64)
                np.add.at(total, at, p)
                sums.append(total)
            answers = 2 * answer(sums)[at]
            counting = np.flatnonzero(parts[0] > 0)
            answers[counting[np.unique(at[counting], return_index=True)[1]]] += 1
            out = np.split(answers, np.cumsum(sizes)[:-1])
            distinct = [int((sums[0] > 0).sum())] + [0] * (len(held) - 1)
            columns = [pa.array([now] * len(held), pa.int64()), pa.array([c for c, *_ in held], pa.int64()), pa.array([hashing.packed(hashing.signed(x)) for x in out], pa.binary()), pa.array(distinct, pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, ["range", "chunk", "answer", "distinct"])

        for batch in batches:
            for r, c, k, v in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if r != now and held:
                    yield told()
                now = r
                held.append((c, k, v))
        if held:
            yield told()

    return sent.repartition(ranges, "range").sortWithinPartitions("range", "chunk").mapInArrow(run, "range long, chunk long, answer binary, distinct long")


def _joined(answers: list[dict], level: int) -> tuple[np.ndarray, np.ndarray]:
    """The answers of a level's ranges in their order, and which keys this chunk owns."""
    own = [hashing.unsigned(hashing.unpacked(x["answer"])) for x in sorted(answers, key=lambda x: x["range"]) if x["range"] >> 40 == level]
    both = np.concatenate(own) if own else np.zeros(0, dtype=np.int64)
    return both >> 1, (both & 1) > 0


def _totals(answers: list[dict], depth: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(counts, ownership) of a chunk's strings by length."""
    both = [_joined(answers, j) for j in range(depth + 1)]
    return [t for t, _ in both], [o for _, o in both]


def score_texts(docs: DataFrame, trains: Column, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH, least: int = LEAST, gain: float = GAIN, discount: float = DISCOUNT, size: int = CHUNK, entries: int = ENTRIES) -> DataFrame:
    """One row per row of docs: doc_id, trains, n_tokens, n_known, train_tokens, base_score, score, n_contexts.

    trains: a condition on docs' columns; rows that meet it are learned from. n_contexts: tokens with a retained context.
    """
    shelf = Shelf(docs.sparkSession, "suffix-tree")
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(trains, F.lit(True)).alias("trains"), F.col(text).alias("text")).withColumn("rid", F.monotonically_increasing_id())
    kept = shelf.keep(chunked(own, depth, size), "chunks")
    n_all, n = (x or 0 for x in kept.agg(F.sum("n"), F.sum("trained")).first())
    bits, ranges = min(64, max(1, n_all).bit_length() + SPARE), n_all // entries + 1
    widths = [64] + [bits] * depth

    def opened(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.StructScalar, Chunk]]:
        for c, d, vocab, stream in zip(batch["chunk"].to_pylist(), batch["docs"], batch["vocab"], batch["stream"], strict=True):
            d = d.values
            yield c, d, Chunk(vocab.as_py(), stream.as_py(), d.field("size").to_numpy().astype(np.int64), d.field("trains").to_numpy(zero_copy_only=False), depth, bits)

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, _, chunk in opened(batch):
                for j, (keys, counts) in enumerate(zip(chunk.keys, chunk.own, strict=True)):
                    yield _batch(list(_sent(c, j, widths[j], ranges, keys, [counts])))

    counted = shelf.keep(summed(kept.mapInArrow(strings, SENT), lambda sums: sums[0], ranges), "counted")
    distinct = counted.where(F.shiftright("range", 40) == 0).agg(F.sum("distinct")).first()[0] or 0
    v = distinct - (n > 0)  # a start is no word

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (c, _, chunk), answers in zip(opened(batch), batch["answers"].to_pylist(), strict=True):
                totals, owned = _totals(answers, depth)
                for j in range(1, depth + 1):
                    asked, nexts, ratio = chunk.divergence(totals, owned[j], j, n, least)
                    yield _batch(list(_sent(c, j + depth, widths[j - 1], ranges, chunk.keys[j - 1][asked], [nexts[asked], ratio[asked]])))

    def retained(sums: list[np.ndarray]) -> np.ndarray:
        """The number of distinct next tokens of a context that is retained; 0 for others."""
        return np.where(sums[1] >= gain * BIT * sums[0], sums[0], 0)

    of_chunk = lambda answers: kept.join(answers.groupBy("chunk").agg(F.collect_list(F.struct("range", "answer")).alias("answers")), "chunk")
    judged = shelf.keep(summed(of_chunk(counted).mapInArrow(contexts, SENT), retained, ranges), "judged")
    kind = own.schema["doc_id"].dataType.simpleString()

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (_, parts, chunk), answers in zip(opened(batch), batch["answers"].to_pylist(), strict=True):
                totals, owned = _totals(answers, depth)
                known = Counts(chunk, totals, n)
                base = (known.both[0] + 0.1) / (n + 0.1 * (v + 1))
                p, inside = base.copy(), np.zeros(len(base), dtype=bool)
                for j in range(1, depth + 1):
                    asked = chunk.divergence(totals, owned[j], j, n, least)[0]
                    nexts = np.zeros(len(asked), dtype=np.int64)
                    nexts[asked] = _joined(answers, j + depth)[0]
                    nexts = nexts[chunk.context(j)]
                    on = chunk.token & (nexts > 0)
                    p[on] = (np.maximum(known.both[j][on] - discount, 0) + discount * nexts[on] * p[on]) / known.context[j][on]
                    inside |= on
                total = lambda x: np.add.reduceat(np.where(chunk.token, x, 0), chunk.begin)  # noqa: E731, B023
                columns = [total(1), total((known.both[0] > 0).astype(np.int64)), total(np.log10(base)), total(np.log10(p)), total(inside.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([*(parts.field(x) for x in ("rid", "doc_id", "trains")), *map(pa.array, columns)], ["rid", "doc_id", "trains", "n_tokens", "n_known", "base", "score", "inside"])

    told = of_chunk(counted.select("chunk", "range", "answer").union(judged.select("chunk", "range", "answer")))
    told = told.mapInArrow(scores, f"rid long, doc_id {kind}, trains boolean, n_tokens long, n_known long, base double, score double, inside long")
    sums = [F.sum(x).alias(y) for x, y in (("n_tokens", "n_tokens"), ("n_known", "n_known"), ("base", "base_score"), ("score", "score"), ("inside", "n_contexts"))]
    out = told.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.first("trains").alias("trains"), *sums)
    return out.select("doc_id", "trains", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", "n_contexts")


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", ["doc_id", "text"])
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    out = score_texts(docs, ~held)
    return out.select("doc_id", (~F.col("trains")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_contexts")
