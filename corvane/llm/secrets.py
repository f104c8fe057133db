"""Secret scan: fixed patterns, and sliding-window Shannon entropy over candidate strings.

Candidates are maximal runs of the letters that keys are written in. A window slides over each; counts, the sum of
c*log2(c) and the numbers of letters of each kind change by one letter in and one out, so a step costs the same
whatever the window. Windows over the threshold of their own character class are joined to spans. Allow-lists
suppress what only looks random: whole candidates of fixed form, and windows that touch a word. Spans of the fixed
patterns always stay, and of entropy spans the parts that no such span covers.

Scale: one pass over whole texts, a row in and a row out, nothing is shuffled.

Defined results: a null or empty text has no spans; equal rows are scanned each; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

# fixed values
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "entropy")

KEYWORDS = ("passw", "secret", "token", "api")
WINDOW = 16
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{%d,}" % WINDOW)
PIECE = re.compile(r"[A-Za-z0-9]+")
#: Class of a window, by least numbers of its lower-case letters, upper-case letters, digits and signs + and /, and of
#: letters beyond F; most of each; and the entropy in bits that flags it. The first that fits counts. A window with
#: another sign, or with digits or one case of letters only, has none.
CLASSES = (
    ("hex", (2, 0, 2, 0, 0), (99, 0, 99, 0, 0), 2.6),
    ("HEX", (0, 2, 2, 0, 0), (0, 99, 99, 0, 0), 2.6),
    ("lower", (4, 0, 2, 0, 1), (99, 0, 99, 0, 99), 3.1),
    ("upper", (0, 4, 2, 0, 1), (0, 99, 99, 0, 99), 3.1),
    ("mixed", (2, 2, 0, 0, 1), (99, 99, 99, 0, 99), 3.25),
    ("base64", (3, 3, 1, 1, 1), (99, 99, 99, 3, 99), 3.4),
)
#: Candidates that are never flagged by entropy: identifiers of fixed form.
ALLOWED = (r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",)
#: Pieces of letters and digits that no flagged window touches: words, words that begin with capitals, with a number or a letter before or after.
#: Each splits a piece in one way only, so that a match that fails takes no longer than the piece.
WORDS = (
    r"[A-Z]?[a-z]{3,}[0-9]{0,4}",
    r"[A-Z]{3,}[0-9]{0,4}",
    r"[0-9]{1,4}[A-Za-z]?[a-z]{3,}",
    r"[a-z]*(?:[A-Z]{1,5}[a-z]{2,})+[A-Z]{0,5}[0-9]{0,4}",
    r"(?:[A-Z]?[a-z]{3,}[0-9]{1,2})+",
)


def _any(patterns: tuple[str, ...]) -> re.Pattern | None:
    return re.compile("|".join(f"(?:{x})" for x in patterns)) if patterns else None


def _kind(letter: str) -> int:
    """0: lower-case letter, 1: upper-case letter, 2: digit, 3: + or /, 4: another sign."""
    return 0 if "a" <= letter <= "z" else 1 if "A" <= letter <= "Z" else 2 if "0" <= letter <= "9" else 3 if letter in "+/" else 4


def entropy_spans(run: str, window: int = WINDOW, classes=CLASSES, words: re.Pattern | None = None) -> list[tuple[int, int]]:
    """Joined spans of the windows of run whose entropy reaches the threshold of their class. words: of pieces that no such window touches."""
    taken = [m.span() for m in PIECE.finditer(run) if words is not None and m.end() - m.start() >= 3 and words.fullmatch(m[0])]
    term = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    counts: dict[str, int] = {}
    have = [0] * 6  # by kind; and letters beyond F
    total, spans, log_w, blocked = 0.0, [], math.log2(window), 0
    for i, letter in enumerate(run):
        if i >= window:
            old = run[i - window]
            c = counts[old]
            total += term[c - 1] - term[c]
            counts[old] = c - 1
            have[_kind(old)] -= 1
            have[5] -= old.upper() > "F"
        c = counts.get(letter, 0)
        total += term[c + 1] - term[c]
        counts[letter] = c + 1
        have[_kind(letter)] += 1
        have[5] += letter.upper() > "F"
        at = i - window + 1
        while blocked < len(taken) and taken[blocked][1] <= at:
            blocked += 1
        if at < 0 or have[4] or (blocked < len(taken) and taken[blocked][0] <= i):
            continue
        own = (*have[:4], have[5])
        least = next((t for _, low, high, t in classes if all(a <= x <= b for a, x, b in zip(low, own, high, strict=True))), math.inf)
        if log_w - total / window >= least - 1e-9:
            if spans and spans[-1][1] >= at:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((at, i + 1))
    return spans


def scanner(window: int = WINDOW, classes=CLASSES, allowed=ALLOWED, words=WORDS):
    """A function from a text to its spans: (kind, start, end) by start, then kind as listed; code points, end exclusive."""
    allow, words = _any(allowed), _any(words)

    def scan(text: str) -> list[tuple[str, int, int]]:
        found: list[tuple[str, int, int]] = []
        low = text.lower()
        if any(k in low for k in KEYWORDS):
            found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        runs = [(m.start(), m[0]) for m in CANDIDATE.finditer(text)]
        for at, run in runs:  # both patterns lie within a run
            found += [("access", at + m.start(), at + m.end()) for m in ACCESS.finditer(run)]
            found += [("hex", at + m.start(), at + m.end()) for m in HEX.finditer(run)]
        base = sorted(found, key=lambda s: s[1])
        for at, run in runs:
            if allow is not None and allow.fullmatch(run):
                continue
            for a, b in entropy_spans(run, window, classes, words):
                a, b = at + a, at + b
                for _, x, y in base:
                    if a < x < b:
                        found.append(("entropy", a, x))
                    if x < b and a < y:
                        a = y
                if a < b:
                    found.append(("entropy", a, b))
        found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
        return found

    return scan


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, classes=CLASSES, allowed=ALLOWED, words=WORDS) -> DataFrame:
    """One row per row of docs: doc_id and spans, an array of (kind, start, end)."""
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(window, classes, allowed, words)
        for batch in batches:
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in scan(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(kind))], ["doc_id", "spans"])

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:int,end:int>>")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read(spark, sf_dir, "documents", ["doc_id", "text"]))
    of = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long")
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    base = F.filter("spans", lambda s: s.kind != "entropy")
    return found.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"), of("entropy").alias("n_entropy"))
