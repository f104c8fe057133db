"""Text quality: random-indexing word vectors pooled per document, and a two-layer network with calibrated probabilities.

Words are runs of letters (cut before a capital that follows a small letter), of digits or of other signs, case-sensitive,
and meet in BUCKETS buckets by a hash. A bucket's index vector is sparse and ternary and follows from its number. Its word vector is the sum of
the index vectors of its neighbours within REACH words, over all words of all documents; the vectors' common direction
is taken out and they are scaled to length 1. A document is pooled to the mean and the spread of its words'
vectors, rare words counting more, as their share of the corpus tells, and to the mean cosine of neighbours at each distance.

A hidden layer of tanh units and a logistic output learn the labels, from a sample of at most about SAMPLE labelled
documents chosen by a hash. A fifth of the sample is set aside: a temperature that divides the output is chosen on it,
so that scores are probabilities.

Scale: word vectors are whole-number sums, so they come out alike however documents are dealt. A task adds up its own
part, parts meet in two levels of blocks of buckets, and the table has BUCKETS rows at any size of the corpus (16 MB),
which bounds what the driver and each worker hold. Scoring is one pass over whole texts, a row in and a row out.

Defined results: a null or empty text is pooled to zeros and scored like any other; a null label teaches nothing, and
of several labels for a document the highest counts; of rows with one doc_id one teaches, whose pooled values are the
least; without both classes in the sample all scores are the share of label 1 in it, or 0 without rows; equal rows are
scored each; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing
from .common import read

BITS = 16
BUCKETS = 1 << BITS
WIDTH = 64
#: Components of an index vector that are not zero; half of them are negative.
MARKS = 4
#: Words to each side that are neighbours.
REACH = 2
#: Values that a document is pooled to.
POOLED = 2 * WIDTH + REACH
#: Buckets that are summed in one row.
BLOCK = 1024
SALTS = 32
SAMPLE = 20_000
HIDDEN = 32
THRESHOLD = 0.5
#: A word of this share of the corpus counts half as much as a rare one.
COMMON = 1e-3

#: Class of a byte: 0 white space, 1 small letters and bytes beyond ASCII, 2 capitals, 3 digits, 4 the others.
_class = np.full(256, 4, dtype=np.int8)
_class[[32, 9, 10, 11, 12, 13]] = 0
_class[97:123] = _class[128:] = 1
_class[65:91] = 2
_class[48:58] = 3
_letters = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of each bucket's index vector: places of its marks, and what stands there."""
    r = np.random.default_rng(BITS)
    return r.integers(0, WIDTH, (BUCKETS, MARKS)).astype(np.int32), np.tile(np.array([1, -1], dtype=np.int32), MARKS // 2)


def _runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    kind = _class[a]
    edge = np.concatenate([[0], kind, [0]])
    cut = np.flatnonzero((edge[1:] != edge[:-1]) & ~((edge[:-1] == 2) & (edge[1:] == 1)))
    start, end = cut[:-1], cut[1:]
    solid = kind[start] > 0 if len(start) else np.zeros(0, dtype=bool)
    start, end = start[solid], end[solid]
    text_end = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    of = np.searchsorted(text_end, start, side="right")
    h = hashing.runs(_letters[a], start, end, hashing.MULTIPLIER, "quality") if len(start) else np.zeros(0, dtype=np.uint64)
    return (h >> np.uint64(64 - BITS)).astype(np.int32), of


def buckets(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, texts) of the words of texts in their order, in parts of a bounded size. A very long text comes in several."""
    for at, to in hashing.chunks(texts):
        for part in hashing.pieces(texts[at]) if to == at + 1 else (None,):
            h, of = _runs(texts[at:to] if part is None else [part])
            yield h, of + at


def neighbours(h: np.ndarray, of: np.ndarray, places: np.ndarray, signs: np.ndarray, total: np.ndarray) -> None:
    """Adds to total (by bucket and component) the index vectors of each word's neighbours in its text."""
    flat, base = total.reshape(-1), h.astype(np.int64) * WIDTH
    marks: dict[int, list[np.ndarray]] = {1: [], -1: []}
    for gap in range(1, REACH + 1):
        same = of[gap:] == of[:-gap]
        for x, y in ((base[gap:], h[:-gap]), (base[:-gap], h[gap:])):
            x, y = x[same], y[same]
            for m in range(MARKS):
                marks[int(signs[m])].append(x + places[y, m])
    for sign, at in marks.items():  # counting all places at once is several times as fast as adding one by one
        flat += sign * np.bincount(np.concatenate(at), minlength=len(flat))


def _pack(values: np.ndarray) -> bytes:
    return hashing.packed(hashing.signed(values.reshape(-1)))


def _unpack(data: bytes) -> np.ndarray:
    return hashing.unsigned(hashing.unpacked(data))


def context_sums(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(sums of neighbours' index vectors, number of words) of each bucket over all docs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        total, seen, salt = np.zeros((BUCKETS, WIDTH), dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64), 0
        for batch in batches:
            if batch.num_rows:
                salt = batch.column(1)[0].as_py() % SALTS
            for h, of in buckets([(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(0).cast(pa.binary())]):
                seen += np.bincount(h, minlength=BUCKETS)
                neighbours(h, of, places, signs, total)
        for at in range(0, BUCKETS, BLOCK):
            if seen[at : at + BLOCK].any():
                both = np.concatenate([total[at : at + BLOCK].reshape(-1), seen[at : at + BLOCK]])
                yield pa.RecordBatch.from_arrays([pa.array([at // BLOCK], pa.int32()), pa.array([salt], pa.int32()), pa.array([_pack(both)], pa.binary())], ["block", "salt", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for block, salt, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if (block, salt) != now and now is not None:
                    yield _row(now, total)
                    total = None
                now, part = (block, salt), _unpack(sums.as_buffer())
                total = part if total is None else total + part
        if now is not None:
            yield _row(now, total)

    def _row(key: tuple[int, int], total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([0], pa.int32()), pa.array([_pack(total)], pa.binary())], ["block", "salt", "sums"])

    schema = "block int, salt int, sums binary"
    parts = docs.select(F.col(text).alias("text"), F.spark_partition_id().alias("part")).mapInArrow(count, schema)
    for keys in (["block", "salt"], ["block"]):
        parts = parts.repartition(*keys).sortWithinPartitions("block", "salt").mapInArrow(add, schema)
    sums, seen = np.zeros((BUCKETS, WIDTH), dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
    for r in parts.collect():  # a row a block: BUCKETS / BLOCK
        both = _unpack(r.sums)
        at = r.block * BLOCK
        sums[at : at + BLOCK], seen[at : at + BLOCK] = both[: BLOCK * WIDTH].reshape(BLOCK, WIDTH), both[BLOCK * WIDTH :]
    return sums, seen


@dataclass
class Words:
    """vectors: of length 1, by bucket. weight: of a word in the pool."""

    vectors: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, sums: np.ndarray, seen: np.ndarray) -> Words:
        n = max(1, int(seen.sum()))
        mean = sums / np.maximum(1, seen)[:, None]
        vectors = mean - (seen @ mean / n)[None, :]
        vectors /= np.maximum(1e-9, np.sqrt((vectors**2).sum(axis=1)))[:, None]
        vectors[seen == 0] = 0
        return cls(vectors.astype(np.float32), (COMMON / (COMMON + seen / n)).astype(np.float32))

    def pool(self, texts: list[bytes]) -> np.ndarray:
        """Mean and spread of the words' vectors of each text, and the mean cosine of words one and two places apart."""
        n = len(texts)
        total, squares, weight, agree, pairs = np.zeros((n, WIDTH)), np.zeros((n, WIDTH)), np.zeros(n), np.zeros((n, REACH)), np.zeros((n, REACH))
        for h, of in buckets(texts):
            if not len(h):
                continue
            for gap in range(1, REACH + 1):
                for at in range(0, len(h) - gap, 50_000):  # a bounded number of vectors at once
                    b, own = h[at + gap : at + gap + 50_000], of[at + gap : at + gap + 50_000]
                    a, same = h[at : at + len(b)], of[at : at + len(b)] == own
                    own = own[same]
                    if len(own):
                        there = slice(int(own[0]), int(own[-1]) + 1)
                        agree[there, gap - 1] += np.bincount(own - own[0], weights=np.einsum("ij,ij->i", self.vectors[a[same]], self.vectors[b[same]]))
                        pairs[there, gap - 1] += np.bincount(own - own[0])
            # equal words of a text count at once
            key, times = np.unique(of.astype(np.int64) << BITS | h, return_counts=True)
            of, h = key >> BITS, key & (BUCKETS - 1)
            w = self.weight[h] * times.astype(np.float32)
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            v = self.vectors[h]
            x = v * w[:, None]
            at = of[first]
            total[at] += np.add.reduceat(x, first, axis=0)
            squares[at] += np.add.reduceat(x * v, first, axis=0)
            weight[at] += np.add.reduceat(w, first)
        mean = total / np.maximum(1e-9, weight)[:, None]
        spread = np.sqrt(np.maximum(0, squares / np.maximum(1e-9, weight)[:, None] - mean**2))
        return np.concatenate([mean, spread, agree / np.maximum(1, pairs)], axis=1)


@dataclass
class Network:
    """prior: the score that is given where nothing could be learned."""

    shift: np.ndarray | None = None
    scale: np.ndarray | None = None
    w1: np.ndarray | None = None
    b1: np.ndarray | None = None
    w2: np.ndarray | None = None
    b2: float = 0.0
    temperature: float = 1.0
    prior: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.shift) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -35, 35)))


def log_loss(logits: np.ndarray, y: np.ndarray, temperature: float = 1.0) -> float:
    z = logits / temperature
    return float((np.logaddexp(0, z) - y * z).mean())


def fit(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = 40, rate: float = 3e-3, decay: float = 1e-3, batch: int = 128, seed: int = 5) -> Network:
    """Adam on the log loss of four fifths of the rows; the rest chooses the epoch and then the temperature."""
    if not len(y) or y.min() == y.max():
        return Network(prior=float(y.mean()) if len(y) else 0.0)
    r = np.random.default_rng(seed)
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[~held])) < 2 or not held.any():
        held[:] = False
    check = held if held.any() else ~held
    shift, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z, t = (x[~held] - shift) / scale, y[~held]
    p = [r.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), r.normal(0, 1 / np.sqrt(hidden), hidden), np.array(np.log(t.mean() / (1 - t.mean())))]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    best, least = None, np.inf
    for _ in range(epochs):
        order = r.permutation(len(t))
        for at in range(0, len(t), batch):
            rows = order[at : at + batch]
            a = np.tanh(z[rows] @ p[0] + p[1])
            g = (1 / (1 + np.exp(-np.clip(a @ p[2] + p[3], -35, 35))) - t[rows]) / len(rows)
            back = g[:, None] * p[2] * (1 - a * a)
            grads = [z[rows].T @ back + decay * p[0], back.sum(axis=0), a.T @ g + decay * p[2], g.sum()]
            step += 1
            for i, own in enumerate(grads):
                m[i], v[i] = 0.9 * m[i] + 0.1 * own, 0.999 * v[i] + 0.001 * own**2
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        net = Network(shift, scale, *(a.copy() for a in p[:3]), float(p[3]))
        if (loss := log_loss(net.logits(x[check]), y[check])) < least:
            best, least = net, loss
    logits = best.logits(x[check])
    best.temperature = min(np.exp(np.linspace(-1.5, 2.5, 161)), key=lambda k: log_loss(logits, y[check], k))
    return best


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> tuple[Words, Network]:
    """Word vectors of all docs and the network of about sample labelled ones at most. labels: doc_id and label."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    words = Words.of(*context_sums(own))
    ids = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("y")).where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").cast("int").alias("y"))
    n = ids.count()
    if n > sample:  # an equal share of the hash's range
        ids = ids.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 33) < int(sample / n * 2**31))
    sent = docs.sparkSession.sparkContext.broadcast(words)  # BUCKETS rows

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = sent.value.pool([t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(2).cast(pa.binary())])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x.astype("<f4")], pa.binary())], ["place", "y", "x"])

    # the sample is bounded, so its ids are broadcast and no text moves; of rows with one id one is taken
    rows = own.join(F.broadcast(ids), "doc_id").select(F.xxhash64("doc_id").alias("place"), "y", "text").mapInArrow(pooled, "place long, y int, x binary")
    rows = sorted(rows.groupBy("place").agg(F.max("y").alias("y"), F.min("x").alias("x")).collect())
    x = np.frombuffer(b"".join(r.x for r in rows), "<f4").reshape(len(rows), POOLED).astype(np.float64)
    return words, fit(x, np.array([float(r.y > 0) for r in rows]))


def score(docs: DataFrame, words: Words, network: Network, doc_id: str = "doc_id", text: str = "text", out: str = "score") -> DataFrame:
    """One row per row of docs: doc_id and score."""
    sent = docs.sparkSession.sparkContext.broadcast((words, network))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, network = sent.value
        for batch in batches:
            x = words.pool([t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(1).cast(pa.binary())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(network.scores(x.astype("<f4").astype(np.float64)), pa.float64())], ["doc_id", out])

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, {out} double")


def _fold(doc_id, of: int):
    return F.crc32(doc_id.cast("string").cast("binary")) % of


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", ["doc_id", "text"])
    labels = read(spark, sf_dir, "labels", ["doc_id", "quality"]).where(_fold(F.col("doc_id"), 3) != 1)
    out = score(docs, *train(docs, labels))
    return out.select("doc_id", F.coalesce(_fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
