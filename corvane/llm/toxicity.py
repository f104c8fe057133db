"""Toxicity by a counterfactually regularised classifier.

A sparse logistic regression over words and word beginnings. For training sentences that mention a group, the
identity term is swapped for others of the list, and squared changes of the score are penalised: a group's
mention cannot raise or lower a score by itself, which spares neutral mentions.

The fit takes a sample of at most about SAMPLE labelled rows, chosen by a hash; features of the sample are
computed on executors and its size, not the corpus's, bounds what the driver holds. Scoring is one pass over
whole texts with a row in and a row out.

Defined results: a null or empty text gets the score of a text without words; a null label teaches nothing, and
of several labels for a document the highest counts; without both classes in the sample all scores are the share
of label 1 in it, or 0 without rows; equal rows are scored each; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

SAMPLE = 20_000
BITS = 20
THRESHOLD = 0.3
#: A feature counts at most so often in a text.
MOST = 3
WORDS = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")
#: Most words in the cache of one Python worker.
CACHE = 400_000
#: Rows that are told apart at once: what leaves a worker is small, however large the batches are that reach it.
ROWS = 500
#: Terms that name groups; mentions of them are neutral by themselves.
IDENTITY = tuple(
    "women men woman man girls boys gay lesbian bisexual transgender queer straight black white asian african latino european american mexican chinese indian arab jewish jews muslim muslims "
    "christian christians hindu buddhist atheist catholic immigrants immigrant refugees refugee migrants disabled deaf blind autistic elderly old young teenagers "
    "frauen männer juden muslime christen ausländer flüchtlinge behinderte schwarze femmes hommes juifs musulmans chrétiens immigrés réfugiés handicapés noirs mujeres hombres judíos musulmanes cristianos inmigrantes refugiados discapacitados negros".split()
)


def features(word: str) -> list[int]:
    """Hashed features of a lower-case word: itself and its beginnings of four and five letters."""
    out = [zlib.crc32(b"w" + word.encode()) >> (32 - BITS)]
    return out + [zlib.crc32(b"p" + word[:n].encode()) >> (32 - BITS) for n in (4, 5) if len(word) > n]


def words(text: str) -> set[str]:
    return set(WORDS.findall(text.lower()))


def _counts(text: str) -> Counter:
    return Counter(f for w in words(text) for f in features(w))


def mentions(text: str, terms: tuple[str, ...] = IDENTITY) -> Counter:
    """How many sentences of text mention each identity term, by the term's place."""
    of = {t: i for i, t in enumerate(terms)}
    return Counter(of[w] for sentence in SENTENCE.split(text.lower()) for w in set(WORDS.findall(sentence)) if w in of)


def swaps(mentioned: Counter, terms: tuple[str, ...] = IDENTITY, each: int = 3) -> list[tuple[int, list[tuple[int, int]]]]:
    """For each mentioned term and some others: how many sentences swap them, and what changes in their features.

    In a linear score the rest of a sentence cancels out, so equal swaps are one change with a count.
    """
    out = []
    for i, n in sorted(mentioned.items()):
        for j in range(1, each + 1):
            change = Counter(features(terms[(i + j * 7) % len(terms)]))
            change.subtract(features(terms[i]))
            out.append((n, [(f, c) for f, c in change.items() if c]))
    return out


@dataclass
class Model:
    """weights: of features that have one. prior: the score that is given if there is nothing to weigh."""

    bias: float = 0.0
    weights: dict[int, float] = field(default_factory=dict)
    prior: float | None = None

    def scorer(self):
        """A function from a text to its score."""
        cache: dict[str, float] = {}
        get = self.weights.get

        def of(word: str) -> float:
            got = cache.get(word)
            if got is None:
                if len(cache) >= CACHE:
                    cache.clear()
                got = cache[word] = sum(get(f, 0.0) for f in features(word))
            return got

        def score(text: str) -> float:
            if self.prior is not None:
                return self.prior
            found = words(text)
            try:
                total = sum([cache[w] for w in found])
            except KeyError:
                total = sum([of(w) for w in found])
            return float(1 / (1 + np.exp(-np.clip(self.bias + total, -35, 35))))

        return score


def fit(docs_x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, changes: list[tuple[int, list[tuple[int, int]]]], rows_least: float = 3.0, swap_penalty: float = 1.0, z_least: float = 3.0, steps: int = 400) -> Model:
    """Accelerated proximal gradient on mean log loss + swap_penalty * mean squared score change + l1 * |weights|.

    changes: of features by swaps, with the number of sentences of each; they weigh in the mean.
    Features enter if their rows' share of label 1 is z_least standard errors or more from the overall share, or
    if a swap changes them. l1 is such that a feature needs rows_least rows of unexplained labels for a weight;
    those that have one are then fitted again with a tenth of it.
    """
    if len(y) == 0 or y.min() == y.max():
        return Model(prior=float(y.mean()) if len(y) else 0.0)
    n, share = len(y), y.mean()
    # features are BITS wide: they are counted in place, and only those that enter are brought together
    seen, toxic = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for (f, _), label in zip(docs_x, y, strict=True):
        seen[f] += 1
        toxic[f] += label
    keep = (np.abs(toxic - seen * share) >= z_least * np.sqrt(seen * share * (1 - share))) & (seen >= rows_least)
    keep[sorted({f for _, c in changes for f, _ in c})] = True
    keep &= seen > 0
    place, used = np.cumsum(keep) - 1, np.flatnonzero(keep)
    own = [keep[f] for f, _ in docs_x]
    row = np.repeat(np.arange(n), [int(k.sum()) for k in own])
    col = place[np.concatenate([f[k] for (f, _), k in zip(docs_x, own, strict=True)])]
    x = np.minimum(np.concatenate([c[k] for (_, c), k in zip(docs_x, own, strict=True)]), MOST).astype(np.float64)
    d, at = len(used), {int(f): i for i, f in enumerate(used)}
    c_row = np.array([i for i, (_, c) in enumerate(changes) for f, _ in c if f in at], dtype=np.int64)
    c_col = np.array([at[f] for _, c in changes for f, _ in c if f in at], dtype=np.int64)
    c_val = np.array([v for _, c in changes for f, v in c if f in at], dtype=np.float64)
    c_share = np.array([k for k, _ in changes], dtype=np.float64)
    c_share /= max(c_share.sum(), 1)
    # a diagonal that bounds the curvature, so that each weight has its own safe step
    reach = np.bincount(row, weights=x, minlength=n) + 1
    bound = np.bincount(col, weights=x * reach[row], minlength=d) / (4 * n)
    if len(changes):
        c_reach = np.bincount(c_row, weights=np.abs(c_val), minlength=len(changes))
        bound += 2 * swap_penalty * np.bincount(c_col, weights=np.abs(c_val) * (c_share * c_reach)[c_row], minlength=d)
    step, b_step, l1 = 1 / np.maximum(bound, 1e-12), 4 / reach.mean(), rows_least / n
    w, b, t = np.zeros(d), float(np.log(share / (1 - share))), 1.0
    z, zb = w, b
    for i in range(2 * steps):
        if i == steps:  # what has no weight by now stays out, and the others are shrunk less
            step, l1, t = np.where(w != 0, step, 0.0), l1 / 10, 1.0
            z, zb = w, b
        p = 1 / (1 + np.exp(-np.clip(zb + np.bincount(row, weights=x * z[col], minlength=n), -35, 35)))
        g = np.bincount(col, weights=x * (p - y)[row], minlength=d) / n
        if len(changes):
            change = np.bincount(c_row, weights=c_val * z[c_col], minlength=len(changes))
            g += 2 * swap_penalty * np.bincount(c_col, weights=c_val * (c_share * change)[c_row], minlength=d)
        new = z - step * g
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        new_b, t_next = zb - b_step * float((p - y).mean()), (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, zb = new + (t - 1) / t_next * (new - w), new_b + (t - 1) / t_next * (new_b - b)
        w, b, t = new, new_b, t_next
    return Model(float(b), {int(f): float(v) for f, v in zip(used, w, strict=True) if v})


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, terms: tuple[str, ...] = IDENTITY, swap_penalty: float = 1.0) -> Model:
    """The model of about sample labelled rows at most. labels: doc_id and label."""
    ids = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("y")).where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").cast("int").alias("y"))
    n = ids.count()
    if n > sample:  # an equal share of the hash's range
        ids = ids.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 33) < int(sample / n * 2**31))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [_counts(t.as_py() or "") for t in batch.column(1)]
            s = [mentions(t.as_py() or "", terms) for t in batch.column(1)]
            columns = [np.fromiter(c, "<u4", len(c)).tobytes() for c in x], [np.minimum(np.fromiter(c.values(), "<i8", len(c)), MOST).astype("u1").tobytes() for c in x]
            flat = [np.array(list(own.items()), dtype="<i4").tobytes() for own in s]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.binary()) for c in (*columns, flat))], ["y", "f", "c", "s"])

    # the sample is bounded, so its ids are broadcast and no text moves
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(ids), "doc_id").select("y", "text")
    rows = own.mapInArrow(extract, "y int, f binary, c binary, s binary").toArrow()
    xs = [(np.frombuffer(f.as_buffer(), "<u4"), np.frombuffer(c.as_buffer(), "u1")) for f, c in zip(rows["f"], rows["c"], strict=True)]  # no copies
    mentioned: Counter = Counter()
    for s in rows["s"].to_pylist():
        for i, k in np.frombuffer(s, "<i4").reshape(-1, 2).tolist():
            mentioned[i] += k
    return fit(xs, np.array(rows["y"].to_pylist(), dtype=np.float64), swaps(mentioned, terms), swap_penalty=swap_penalty)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", out: str = "score") -> DataFrame:
    """One row per row of docs: doc_id and score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # as large as the sample's vocabulary at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = sent.value.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([of(t.as_py() or "") for t in batch.column(1)], pa.float64())], ["doc_id", out])

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, {out} double")


def drop_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is under the threshold, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place, schema = docs.columns.index(text), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = sent.value.scorer()
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                own = batch.slice(i, ROWS)
                yield own.filter(pa.array([of(t.as_py() or "") < threshold for t in own.column(place)], pa.bool_()))

    return docs.mapInArrow(run, schema)


def _fold(doc_id, of: int):
    return F.crc32(doc_id.cast("string").cast("binary")) % of


def query_model(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> Model:
    """The model of the labelled documents outside the held-out fold."""
    docs = read(spark, sf_dir, "documents", ["doc_id", "text"]) if docs is None else docs
    labels = read(spark, sf_dir, "labels", ["doc_id", "toxic"]).where(_fold(F.col("doc_id"), 4) != 2)
    return train(docs, labels)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", ["doc_id", "text"])
    out = score(docs, query_model(spark, sf_dir, docs))
    return out.select("doc_id", F.coalesce(_fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
