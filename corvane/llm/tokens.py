"""Token ids of whole texts by a tokenizer file, with a cache of words.

The tokenizer drops white space between its pieces, so a text's ids are its space-separated chunks' ids in a row,
and a chunk is encoded once for as long as the cache keeps it. Holds for tokenizers that split at white space;
tests compare with encoding the whole text.
"""

from __future__ import annotations

import array
import os
import re
import unicodedata
from collections.abc import Callable

#: A chunk of letters, and full stops or commas after it.
_PLAIN = re.compile(r"([^\W\d_]+)([.,]*)")
#: Most chunks in the cache of one Python worker.
CACHE = 600_000

_loaded: dict[str, Callable[[str], bytes]] = {}


def _letter_bytes() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from code point 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def encoder(path: str) -> Callable[[str], bytes]:
    """A function from a text to its ids as little-endian unsigned 32-bit integers."""
    if path in _loaded:
        return _loaded[path]
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model, letters = tokenizer.model, _letter_bytes()

    def ids(values: list[int]) -> bytes:
        return array.array("I", values).tobytes()

    def lowered(chunk: str) -> str:
        return "".join(c.lower() for c in unicodedata.normalize("NFC", chunk))

    def word(chunk: str) -> bytes:
        if chunk.isascii() and chunk.isalpha():  # these letters stand for themselves in the byte-level alphabet
            return ids([t.id for t in model.tokenize(chunk.lower())])
        if (low := lowered(chunk)).isalpha():  # one piece for the model: neither the pattern nor the normaliser changes it
            return ids([t.id for t in model.tokenize("".join(letters[b] for b in low.encode()))])
        return ids(tokenizer.encode(chunk, add_special_tokens=False).ids)

    def chunk_ids(chunk: str) -> bytes:
        m = _PLAIN.fullmatch(chunk)
        # a letter that turns into a letter and a mark would meet the full stop in one piece
        if m and m[2] and (m[1].isascii() or lowered(m[1]).isalpha()):
            return cache[m[1]] + cache[m[2]]
        return word(chunk) if m and not m[2] else ids(tokenizer.encode(chunk, add_special_tokens=False).ids)

    class Cache(dict):
        """Ids by chunk; what is not there is encoded when it is asked for."""

        def __missing__(self, chunk: str) -> bytes:
            got = chunk_ids(chunk)
            if len(self) >= CACHE:
                self.clear()
            self[chunk] = got
            return got

    cache = Cache()

    def encode(text: str) -> bytes:
        if text.isascii():
            text = text.lower()
        return b"".join([cache[c] for c in text.replace("\n", " ").split(" ")])

    cache[""] = b""
    _loaded[path] = encode
    return encode
