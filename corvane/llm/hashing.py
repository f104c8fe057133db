"""Hashes of words and of runs of words for many texts at once, and sorted hashes in few bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once.
CHUNK = 1 << 20
MULTIPLIER = 0x9E3779B97F4A7C15

_powers: dict[str, np.ndarray] = {}
_bytes = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)
_bytes[65:91] = _bytes[97:123]  # A-Z count as a-z
_space = np.zeros(256, dtype=bool)
_space[[32, 9, 10, 11, 12, 13]] = True


def _power(base: int, n: int, name: str) -> np.ndarray:
    """base to the 0th to nth power, modulo 2 to the 64."""
    got = _powers.get(name)
    if got is None or len(got) <= n:
        got = np.full(max(n + 1, 1024), base % 2**64, dtype=np.uint64)
        got[0] = 1
        _powers[name] = got = np.multiply.accumulate(got)
    return got


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def runs(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int, name: str) -> np.ndarray:
    """Mixed polynomial hashes of values[start:end]."""
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values * _power(base, len(values), name)[: len(values)], dtype=np.uint64)])
    return mixed((total[end] - total[start]) * _power(pow(base, -1, 2**64), len(values), name + "-")[start])


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Successive ranges of texts of about CHUNK bytes; a longer text is a range of its own."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= CHUNK):
            size += len(texts[to])
            to += 1
        yield at, to
        at = to


def pieces(text: bytes) -> Iterator[bytes]:
    """Successive parts of text of at most CHUNK bytes, cut at spaces; a longer word stays whole."""
    at = 0
    while len(text) - at > CHUNK:
        gaps = np.flatnonzero(_space[np.frombuffer(text, dtype=np.uint8, count=CHUNK, offset=at)])
        to = at + int(gaps[-1]) + 1 if len(gaps) else at + CHUNK
        while not len(gaps) and to < len(text) and not _space[text[to]]:
            to += 1
        yield text[at:to]
        at = to
    yield text[at:]


def _hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    gap = _space[a]
    edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    text_end = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    of = np.searchsorted(text_end, start, side="right")
    return runs(_bytes[a], start, end, MULTIPLIER, "bytes") if len(start) else np.zeros(0, dtype=np.uint64), of


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of texts, letters A-Z as lower-case ones, the text of each, and the first word of each text.

    Beside the result, memory follows CHUNK and the longest word, however long a text is.
    """
    found = [(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))]
    for at, to in chunks(texts):
        for part in pieces(texts[at]) if to == at + 1 else (None,):
            h, of = _hashed(texts[at:to] if part is None else [part])
            found.append((h, of + at))
    h, of = (np.concatenate(x) for x in zip(*found, strict=True))
    return h, of, np.searchsorted(of, np.arange(len(texts)), side="left")


def packed(values: np.ndarray) -> bytes:
    """values (64 bits, unsigned) in few bytes: byte by byte of all values, compressed."""
    planes = np.ascontiguousarray(values, dtype="<u8").view(np.uint8).reshape(-1, 8)
    width = int(planes.any(axis=0).nonzero()[0].max(initial=0)) + 1 if len(values) else 0
    return len(values).to_bytes(8, "little") + bytes([width]) + pa.compress(np.ascontiguousarray(planes[:, :width].T).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), data[8]
    out = np.zeros((n, 8), dtype=np.uint8)
    if n:
        out[:, :width] = np.frombuffer(pa.decompress(data[9:], n * width, codec="zstd"), dtype=np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def signed(values: np.ndarray) -> np.ndarray:
    """Signed values as unsigned ones, small for small."""
    v = values.astype(np.int64)
    return ((v << 1) ^ (v >> 63)).view(np.uint64)


def unsigned(values: np.ndarray) -> np.ndarray:
    """What signed() was given."""
    return (values >> np.uint64(1)).astype(np.int64) ^ -(values & np.uint64(1)).astype(np.int64)
