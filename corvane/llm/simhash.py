"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into three segments. If two fingerprints differ in at most two bits, then some
segment is equal in both and the next one (in a ring) differs in at most one bit: errors fall into at most two
segments, and with two errors in different segments the third is equal and its neighbour has one. So a key is a
segment as it is, with a codeword index near to the next segment. The Golay code gives a segment one or six
indices, and segments within one bit of each other share one. Fingerprints that share a key are compared.

That is what near_groups links. Near copies in the usual sense, with a Jaccard similarity of SIMILARITY or more over
sets of five words, lie further apart. near_links finds them by a fingerprint of 128 bits of the set of a text's
words, where each edit moves few bits. Its six segments are decoded in pairs: a key is a codeword index near to one
segment with one near to the other. Pairs of segments with ten errors in all share a key in 99.9 % of cases, with
sixteen in 95 %. Two that differ in REACH bits or less are met at the least key that they share, where a least spanning
forest joins all that meet. Over all its keys each one takes up to NEAREST of its pairs there, its nearest among them;
so a crowd has pairs in proportion to its members, and not to its members' keys. Each pair
is verified by the similarity of the two texts. What is not connected by then meets again at its keys, in rounds: every
pair within reach whose ends lie in different components is bounded from above by the parities of its shingles, and unless
the bound rules it out it waits for verification. A round verifies up to so many of each one's waiting pairs, the likeliest among
them; those that the new links connect need it no more, and the next round takes up to GROWTH times as many. Rounds go on until no
pair waits. So of pairs that share a key and are within reach none is lost, however
crowded the key. A key with over BLOCK fingerprints is split into blocks, each two of which are a unit of their own.

For near_groups, keys are made for distinct fingerprints, so copies never meet. A key with two fingerprints is verified from its
smallest and largest; one with up to CROWD is verified in a row of its own; a more crowded one is split exactly:
two fingerprints are within two bits of each other if and only if they share a word within one bit of both, and
at most 65 fingerprints share such a word. Links form components in distributed rounds.

Defined results: a null text counts as empty; texts without words have fingerprint 0 and link like any other; a
null doc_id takes part but never names a component that has another; equal rows are separate documents; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing
from .common import Shelf, components, loosened, numbered, read, spare
from .golay import near_codewords

BITS = 2
CROWD = 256
#: Shingles that are counted bit by bit at once.
CHUNK = 1 << 16
#: First bit and number of bits of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
SIMILARITY, SHINGLE = 0.8, 5
#: Most bits of 128 that differ in a pair to verify; most fingerprints of a block.
REACH, BLOCK = 24, 4096
#: How many pairs a document takes in the first round at most, and how many times as many in each later one. Pairs that
#: a round leaves out wait for the next, until none is left.
NEAREST, GROWTH = 2, 16
#: Bits of the parities of a text's shingles; most rows with whole texts or shingles that go to a worker at once.
MARKS, ROWS = 4096, 500


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The text's fingerprint: bit i is 1 if over half of the shingles' XXH64 values have it."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    shingle = min(shingle, len(tokens))
    joined, ends = b" ".join(tokens), np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts, n = np.concatenate([[0], ends[:-1] + 1]), len(tokens) - shingle + 1
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for i in range(0, n, CHUNK):
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts[i : min(i + CHUNK, n)].tolist(), ends[i + shingle - 1 : i + shingle - 1 + CHUNK].tolist(), strict=True)]
        ones += np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", shingle: int = 3) -> DataFrame:
    """Columns keep of docs, and fp: the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(batch.num_columns - 1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp)], [*keep, "fp"])

    own = docs.select(*keep, F.col(text).alias("__text"))
    return own.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema[:-1]) + ", fp long")


def golay_keys(fps: DataFrame) -> DataFrame:
    """(key, fp): the keys of each fingerprint, three to eighteen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            part = [((fp >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
            for i in range(3):
                near = near_codewords(part[(i + 1) % 3])
                row, col = np.nonzero(near >= 0)
                key = (np.int64(i) << 36) | (part[i][row] << 12) | near[row, col]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row].view(np.int64))], ["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def _forest(members: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links between members at most bits apart that leave the same ones connected."""
    root = list(range(len(members)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    apart = np.bitwise_count(members[:, None] ^ members[None, :])
    for a, b in zip(*np.nonzero(np.triu(apart <= bits, 1)), strict=True):
        x, y = find(int(a)), find(int(b))
        if x != y:
            root[y] = x
            out.append((int(a), int(b)))
    return out


def _crowd_links(groups: DataFrame, bits: int) -> DataFrame:
    """Links (a, b) within rows of at most CROWD fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for members in batch.column(0):
                m = np.unique(np.array(members.as_py(), dtype=np.int64))
                for i, j in _forest(m.view(np.uint64), bits):
                    a.append(int(m[i]))
                    b.append(int(m[j]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return groups.select("members").mapInArrow(run, "a long, b long")


def links(shelf: Shelf, fps: DataFrame, bits: int = BITS, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) between distinct fingerprints at most bits (two) apart that connect all that are so linked."""
    if not 0 <= bits <= 2:
        raise ValueError("these keys find differences of at most two bits")
    apart = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b)))
    keys = golay_keys(fps)
    met = shelf.keep(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "met")
    out = met.where("n = 2").where(apart("a", "b") <= bits).select("a", "b")
    more = keys.join(loosened(met.where("n > 2").select("key", "n"), "key"), "key")
    few = more.where(F.col("n") <= crowd).groupBy("key").agg(F.collect_list("fp").alias("members"))
    out = out.union(_crowd_links(few, bits))
    # a word within one bit of a fingerprint: the fingerprint, or it with one bit changed
    crowded = more.where(F.col("n") > crowd).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    at = crowded.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("word"))
    around = at.groupBy("word").agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1)
    star = around.select(F.explode("members").alias("a"), F.array_min("members").alias("b")).where("a <> b")
    return out.union(star.where(apart("a", "b") <= bits)).distinct()


def near_groups(docs: DataFrame, keep: list[str], best, text: str = "text", shingle: int = 3, bits: int = BITS) -> DataFrame:
    """Columns keep of docs with fp and first: the least value of best (a column over keep) in the row's component."""
    shelf = Shelf(docs.sparkSession, "simhash")
    rows = shelf.keep(fingerprints(docs, keep, text, shingle), "rows")
    fps = shelf.keep(rows.groupBy("fp").agg(F.min(best).alias("first")), "fps")
    linked = components(shelf, links(shelf, fps, bits)).select(F.col("node").alias("fp"), "root")
    rooted = shelf.keep(fps.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first"), "rooted")
    firsts = loosened(rooted.groupBy("root").agg(F.min("first").alias("first")), "root")
    of_fp = rooted.select("fp", "root").join(firsts, "root").select("fp", "first")
    return rows.join(loosened(of_fp, "fp"), "fp").select(*keep, "fp", "first")


def word_set_fingerprints(texts: list[bytes]) -> np.ndarray:
    """Two 64-bit integers for each text: bit i is 1 if over half of its distinct words' hashes have it."""
    word, of, _ = hashing.words(texts)
    both = np.sort(of.astype(np.uint64) << np.uint64(44) | word >> np.uint64(20))  # the text and 44 bits of the word
    both = both[np.concatenate([[True], both[1:] != both[:-1]])[: len(both)]]
    word, of = both & np.uint64((1 << 44) - 1), (both >> np.uint64(44)).astype(np.int64)
    ones, n = np.zeros((len(texts), 128), dtype=np.int64), np.bincount(of, minlength=len(texts))
    for i in range(0, len(word), CHUNK):
        w, o = word[i : i + CHUNK], of[i : i + CHUNK]
        both = np.stack([hashing.mixed(w * np.uint64(hashing.MULTIPLIER) + np.uint64(k)) for k in (1, 2)], axis=1)
        first = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
        ones[o[first]] += np.add.reduceat(np.unpackbits(both.astype("<u8").view(np.uint8).reshape(-1, 16), axis=1, bitorder="little"), first, axis=0, dtype=np.uint32)
    return np.packbits(ones * 2 > n[:, None], axis=1, bitorder="little").reshape(-1).view("<u8").reshape(-1, 2)


def _long_fingerprints(own: DataFrame) -> DataFrame:
    """(rid, f0, f1) of (rid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t.as_py() or "").encode() for t in batch.column(1)]
            parts = [word_set_fingerprints(texts[a:b]) for a, b in hashing.chunks(texts)]
            del texts
            f = np.concatenate([np.zeros((0, 2), dtype=np.uint64), *parts]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f[:, 0].copy()), pa.array(f[:, 1].copy())], ["rid", "f0", "f1"])

    return own.select("rid", "text").mapInArrow(run, "rid long, f0 long, f1 long")


def _pair_keys(fps: DataFrame, *more: str) -> DataFrame:
    """(key, rid, f0, f1) and more (columns of integers): three to 108 keys of each fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 2000):
                batch = whole.slice(i, 2000)
                f = [batch.column(j).to_numpy(zero_copy_only=False).view(np.uint64) for j in (1, 2)]
                part = [near_codewords(((x >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64)) for x in f for at, n in SEGMENTS]
                for t in range(3):
                    a, b = part[2 * t], part[2 * t + 1]
                    row, x, y = np.nonzero((a >= 0)[:, :, None] & (b >= 0)[:, None, :])
                    key = (np.int64(t) << 24) | (a[row, x] << 12) | b[row, y]
                    yield pa.RecordBatch.from_arrays([pa.array(key), *batch.take(pa.array(row)).columns], ["key", *names])

    names = ["rid", "f0", "f1", *more]
    return fps.select(*names).mapInArrow(run, "key long, " + ", ".join(f"{c} long" for c in names))


def _codewords(f: np.ndarray) -> np.ndarray:
    """Codeword indices near to each of the six segments of fingerprints f (two integers a row), up to six, -1 fills up."""
    return np.stack([near_codewords(((f[:, j] >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64)) for j in (0, 1) for at, n in SEGMENTS], axis=1).astype(np.int16)


def _least_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least key that fingerprints of codewords a and b share, row by row; -1 if there is none."""
    same = (a[:, :, :, None] == b[:, :, None, :]) & (a >= 0)[:, :, :, None]
    least, out = np.where(same, a[:, :, :, None], 4096).min(axis=(2, 3)).astype(np.int64), np.full(len(same), -1, dtype=np.int64)
    for t in (2, 1, 0):
        x, y = least[:, 2 * t], least[:, 2 * t + 1]
        both = (x < 4096) & (y < 4096)
        out[both] = (np.int64(t) << 24) | (x[both] << 12) | y[both]
    return out


def near_pairs(f: np.ndarray, reach: int, key: int) -> list[tuple[int, int]]:
    """Of the pairs of at most reach differing bits whose least shared key is key: those of a least spanning forest.

    f: two integers a row, all of which have the key. The forest holds a nearest one of each that has such others.
    """
    out, apart, to = [], np.full(len(f), 255, dtype=np.int64), np.zeros(len(f), dtype=np.int64)
    left, words = np.ones(len(f), dtype=bool), _codewords(f)
    if _shared_by_all(words, key):
        return out
    for _ in range(len(f)):
        x = int(np.where(left, apart, 256).argmin())
        if apart[x] <= reach:
            out.append((x, int(to[x])))
        left[x] = False
        now = np.bitwise_count(f ^ f[x]).sum(axis=1, dtype=np.int64)
        nearer = np.flatnonzero(left & (now <= reach) & (now < apart))
        nearer = nearer[_least_shared(words[nearer], words[x : x + 1]) == key]
        apart[nearer], to[nearer] = now[nearer], x
    return out


def _shared_by_all(words: np.ndarray, key: int) -> bool:
    """Whether all have a key in common that is less than key."""
    held = [[a for a in words[0, i].tolist() if a >= 0 and (words[:, i] == a).any(axis=1).all()] for i in range(6)]
    least = [(t << 24) | (min(held[2 * t]) << 12) | min(held[2 * t + 1]) for t in range(3) if held[2 * t] and held[2 * t + 1]]
    return bool(least) and min(least) < key


def _met(keys: DataFrame, reach: int) -> DataFrame:
    """Links (a, b, far) of rids within units (key, i, j), which come sorted, each told at the least key that both have. far: bits that differ."""

    def linked(rid: np.ndarray, f: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.stack([rid[x], rid[y], np.bitwise_count(f[x] ^ f[y]).sum(axis=1, dtype=np.int64)], axis=1)

    def links_of(rid: np.ndarray, f: np.ndarray, unit: np.ndarray) -> list[np.ndarray]:
        at = np.flatnonzero(np.concatenate([[True], (unit[1:] != unit[:-1]).any(axis=1)]))
        size = np.diff(np.append(at, len(unit)))
        out, few = [], np.repeat(size <= 8, size)
        for step in range(1, 8):  # all pairs of units of up to eight
            i = np.flatnonzero(few[:-step] & (unit[:-step] == unit[step:]).all(axis=1)) if len(unit) > step else []
            if not len(i):
                break
            i = i[np.bitwise_count(f[i] ^ f[i + step]).sum(axis=1) <= reach]
            for own in np.split(i, range(CHUNK // 8, len(i), CHUNK // 8)):
                own = own[_least_shared(_codewords(f[own]), _codewords(f[own + step])) == unit[own, 0]]
                out.append(linked(rid, f, own, own + step))
        for a, n in zip(at[size > 8], size[size > 8], strict=True):
            pairs = a + np.array(near_pairs(f[a : a + n], reach, int(unit[a, 0])), dtype=np.int64).reshape(-1, 2)
            out.append(linked(rid, f, pairs[:, 0], pairs[:, 1]))
        return out

    def told(rows: np.ndarray) -> pa.RecordBatch:
        found = links_of(rows[:, 3], rows[:, 4:].copy().view(np.uint64), rows[:, :3]) if len(rows) else []
        return _link_batch(np.concatenate(found) if found else np.zeros((0, 3), dtype=np.int64), ["a", "b", "far"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_units(batches):
            yield told(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1))

    return keys.mapInArrow(run, "a long, b long, far long")


def _link_batch(links: np.ndarray, names: list[str]) -> pa.RecordBatch:
    links = np.unique(np.concatenate([np.sort(links[:, :2], axis=1), links[:, 2:]], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(links[:, i].copy()) for i in range(len(names))], names)


def _likeliest(pairs: DataFrame, most: int) -> DataFrame:
    """Of pairs (a, b, far) up to most of each rid's, the one of its least far among them: the least far in each share of its others."""
    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "far").union(pairs.select("b", "a", "far"))
    of = both.groupBy("x", F.pmod(F.xxhash64("y"), F.lit(most)).alias("share")).agg(F.min(F.struct("far", "y")).alias("best"))
    return of.select(F.least("x", "best.y").alias("a"), F.greatest("x", "best.y").alias("b")).distinct()


def _whole_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, sorted by their first three columns (the unit), in batches that cut no unit."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        unit = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
        last = [batch.column(i)[-1].as_py() for i in range(3)]
        other = np.flatnonzero((unit != last).any(axis=1))[-1:]
        cut = int(other[0]) + 1 if len(other) else 0  # from here on the last unit, which may go on
        same = bool(held) and [held[-1].column(i)[-1].as_py() for i in range(3)] == last
        if cut or held and not same:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks().to_batches(max_chunksize=None)[0]
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _units(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """First row and end of each unit."""
    unit = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
    at = np.flatnonzero(np.concatenate([[True], (unit[1:] != unit[:-1]).any(axis=1)]))
    yield from zip(at.tolist(), [*at[1:].tolist(), len(unit)], strict=True)


def _apart(f: np.ndarray, root: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each row of a unit with those that are within reach and have another root."""
    for x in range(len(f)):
        others = np.flatnonzero(root != root[x])
        others = others[np.bitwise_count(f[others] ^ f[x]).sum(axis=1, dtype=np.int64) <= reach]
        if len(others):
            yield x, others


def _crossing(keys: DataFrame, reach: int) -> DataFrame:
    """The rows of units (key, i, j), which come sorted, that are within reach of one of another root in their unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_units(batches):
            f = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (4, 5)], axis=1).view(np.uint64)
            root = batch.column(6).to_numpy(zero_copy_only=False)
            told = np.zeros(batch.num_rows, dtype=bool)
            for a, b in _units(batch):
                for x, _ in _apart(f[a:b], root[a:b], reach):
                    told[a + x] = True
            yield batch.filter(pa.array(told))

    return keys.mapInArrow(run, keys.schema)


def _unruled(keys: DataFrame, reach: int, similarity: float, most: int) -> DataFrame:
    """(a, b, far, more) of rids of different roots within units that may have the similarity, by sizes and marks.

    Sets with that similarity differ in at most (m + n) (1 - similarity) / (1 + similarity) shingles, and the parities
    of their shingles in no more bits. far: the share of shingles that differ at least, in millionths. Each row tells
    its up to most least far ones; more is 1 where it has others. A pair is told at the least key that both have.
    """
    part = (1 - similarity) / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_units(batches):
            key, rid, f0, f1, root, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 3, 4, 5, 6, 7))
            f = np.stack([f0, f1], axis=1).view(np.uint64)
            out = [np.zeros((0, 4), dtype=np.int64)]
            for a, b in _units(batch):
                if (root[a:b] == root[a]).all():
                    continue
                marks = np.frombuffer(b"".join(batch.column(8).slice(a, b - a).to_pylist()), dtype=np.uint64).reshape(b - a, -1)
                words = None
                for x, others in _apart(f[a:b], root[a:b], reach):
                    own = n[a:b][others]
                    others = others[np.abs(own - n[a + x]) <= (own + n[a + x]) * part + 1e-6]
                    total = n[a:b][others] + n[a + x]
                    differ = np.maximum(np.bitwise_count(marks[others] ^ marks[x]).sum(axis=1, dtype=np.int64), np.abs(n[a:b][others] - n[a + x]))
                    stay = differ <= total * part + 1e-6
                    if not stay.any():
                        continue
                    others, far = others[stay], differ[stay] * 1_000_000 // np.maximum(total[stay], 1)
                    words = _codewords(f[a:b]) if words is None else words
                    stay = _least_shared(words[others], words[x : x + 1]) == key[a]
                    others, far = others[stay], far[stay]
                    more = len(others) > most
                    if more:
                        best = np.lexsort((others, far))[:most]
                        others, far = others[best], far[best]
                    out.append(np.stack([np.full(len(others), rid[a + x]), rid[a:b][others], far, np.full(len(others), int(more))], axis=1))
            yield _link_batch(np.concatenate(out), ["a", "b", "far", "more"])

    told = keys.mapInArrow(run, "a long, b long, far long, more long")
    return told.groupBy("a", "b").agg(F.min("far").alias("far"), F.max("more").alias("more"))


def _parities(grams: np.ndarray) -> bytes:
    """For each value of the hash's first bits whether the number of hashes with it is odd, as MARKS bits."""
    return np.packbits(np.bincount((grams >> np.uint64(64 - MARKS.bit_length() + 1)).astype(np.int64), minlength=MARKS) & 1, bitorder="little").tobytes()


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of shingle successive words of each text; of the whole sequence where it is shorter."""
    out = []
    for a, b in hashing.chunks(texts):
        word, _, first = hashing.words(texts[a:b])
        for own in np.split(word, first[1:]):
            n = min(shingle, len(own))
            at = np.arange(len(own) - n + 1 if n else 0)
            out.append(np.unique(hashing.runs(own, at, at + n, 0xD1342543DE82EF95, "words")) if n else own)
    return out


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether sets have that Jaccard similarity; empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def _dealt(keys: DataFrame, crowds: DataFrame, *more: str) -> DataFrame:
    """(key, i, j, rid, f0, f1) and more of keys by units, sorted. crowds: key, and blocks of the keys that are split."""
    dealt = keys.join(loosened(crowds, "key"), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int")
    # two blocks' unit holds both, so a block alone needs one only where it is the only one
    dealt = dealt.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "rid", "f0", "f1", *more)
    return _by_unit(dealt)


def _by_unit(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rid")


def _verified(shelf: Shelf, pairs: DataFrame, grams: DataFrame, similarity: float, name: str) -> DataFrame:
    """Of pairs (a, b) those whose texts have the similarity."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = [similar(*(np.frombuffer(g.as_py(), dtype=np.uint64) for g in pair), similarity) for pair in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(fits, pa.bool_()))

    own = pairs.join(grams.select(F.col("rid").alias("a"), F.col("grams").alias("x")), "a").join(grams.select(F.col("rid").alias("b"), F.col("grams").alias("y")), "b")
    return shelf.keep(own.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long"), name, ROWS)


def _rooted(rows: DataFrame, linked: DataFrame) -> DataFrame:
    """rows with root: that of their rid in linked (node, root), or the rid itself."""
    out = rows.join(loosened(linked.select(F.col("node").alias("rid"), "root"), "rid"), "rid", "left")
    return out.select(*rows.columns, F.coalesce("root", "rid").alias("root"))


def near_links(shelf: Shelf, own: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, reach: int = REACH, block: int = BLOCK) -> DataFrame:
    """Verified links (a, b) between rids of own (rid, text) that connect all that are so linked and met."""
    rows = shelf.keep(_long_fingerprints(own), "long", ROWS)
    fps = shelf.keep(rows.groupBy("f0", "f1").agg(F.min("rid").alias("rid")), "distinct")
    equal = rows.join(loosened(fps.withColumnRenamed("rid", "a"), "f0", "f1"), ["f0", "f1"]).where("a <> rid").select("a", F.col("rid").alias("b"))
    keys, blocks = _pair_keys(fps), F.ceil(F.col("n") / block).cast("int").alias("blocks")
    crowds = shelf.keep(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("key", blocks), "crowds")
    met = shelf.keep(_met(_dealt(keys, crowds), reach), "pairs")
    candidates = shelf.keep(_likeliest(met, NEAREST).union(equal).distinct(), "candidates")
    ids = candidates.select(F.col("a").alias("rid")).union(candidates.select("b")).distinct()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shingle_sets([(t.as_py() or "").encode() for t in batch.column(1)], shingle)
            more = pa.array([len(x) for x in found], pa.int64()), pa.array([_parities(x) for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in found], pa.binary()), *more], ["rid", "grams", "n", "marks"])

    # texts meet ids by sorting at every size, and no broadcast of ids grows with the documents
    grams = own.join(loosened(ids, "rid").hint("merge"), "rid").select("rid", "text").mapInArrow(sets, "rid long, grams binary, n long, marks binary")
    grams = shelf.keep(grams, "grams", ROWS)
    links = _verified(shelf, candidates, grams, similarity, "links")
    # whoever has others within reach is among the ids; keys whose rows are all connected have nothing to add
    rooted = shelf.keep(_rooted(rows.join(loosened(grams.select("rid"), "rid"), "rid"), components(shelf, links, "met")), "rooted")
    keys = _pair_keys(rooted, "root")
    mixed = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("least"), F.max("root").alias("most")).where("least < most")
    mixed = shelf.keep(mixed.select("key", blocks), "mixed")
    dealt = _dealt(keys.join(loosened(mixed.select("key"), "key"), "key", "left_semi"), mixed.where("blocks > 1"), "root")
    crossing, tried, most, turn = shelf.keep(_crossing(dealt, reach), "crossing"), candidates, NEAREST, 0
    while True:
        marked = crossing.join(loosened(grams.select("rid", "n", "marks"), "rid"), "rid").select(*crossing.columns, "n", "marks")
        told = shelf.keep(_unruled(_by_unit(marked), reach, similarity, most), f"told-{turn}")
        waiting = shelf.keep(told.join(tried, ["a", "b"], "left_anti"), f"waiting-{turn}")
        late = shelf.keep(_likeliest(waiting, most), f"late-{turn}")
        links = links.union(_verified(shelf, late, grams, similarity, f"late-links-{turn}"))
        if not told.where("more = 1").take(1) and waiting.count() == late.count():
            return links
        # a row that had nothing to tell has nothing later, as components only grow
        live = told.select(F.col("a").alias("rid")).union(told.select("b")).distinct()
        still = _rooted(crossing.drop("root").join(loosened(live, "rid"), "rid", "left_semi"), components(shelf, links, f"met-{turn}"))
        crossing = shelf.keep(_crossing(_by_unit(still.select(crossing.columns)), reach), f"crossing-{turn}")
        tried, most, turn = tried.union(late), most * GROWTH, turn + 1


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each group of linked ones that with the smallest doc_id."""
    shelf, name = Shelf(docs.sparkSession, "simhash"), spare(docs, "rid")
    own = numbered(docs, name)
    slim = own.select(F.col(name).alias("rid"), F.col(doc_id).alias("id"), F.col(text).alias("text"))
    linked = components(shelf, near_links(shelf, slim, similarity, shingle)).withColumnRenamed("node", "rid")
    known = shelf.keep(slim.select("rid", "id").join(loosened(linked, "rid"), "rid"), "linked")
    best = F.struct(F.col("id").isNull().alias("x"), F.col("id").alias("y"), F.col("rid").alias("z"))
    stay = known.groupBy("root").agg(F.min(best).alias("best"))
    gone = known.join(loosened(stay, "root"), "root").where(F.col("rid") != F.col("best.z")).select(F.col("rid").alias(name))
    return own.join(loosened(gone, name).hint("merge"), name, "left_anti").select(docs.columns)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_groups(read(spark, sf_dir, "documents", ["doc_id", "text"]), ["doc_id"], F.col("doc_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first").alias("component_id"))
