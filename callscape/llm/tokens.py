"""Exact whole-text encoding with a word-level cache in front of the tokenizers library.

A byte-level BPE whose normaliser and pre-tokeniser never join text across
white space encodes a text as the concatenation of its space-separated
chunks, and a chunk of letters with trailing ASCII punctuation as the letters
and then the punctuation. Natural text repeats its words, so most chunks cost
one dictionary lookup. Chunks outside the simple shapes go to the library
whole. `Encoder(path, cached=False)` is the plain path the tests compare with.
"""

from __future__ import annotations

import sys
from array import array
from functools import lru_cache

#: Punctuation that the pre-tokeniser cuts off a run of letters as one piece.
TAIL = ",.!?;:|*&%$#"
#: Fixed value: the first code point after Latin Extended-A.
LATIN_END = "\u0180"


def pack(ids: list[int] | array) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, every other byte for the next free code point from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Cache(dict):
    def __init__(self, compute):
        self.compute = compute

    def __missing__(self, key):
        found = self[key] = self.compute(key)
        return found


class Encoder:
    """Texts to little-endian unsigned 32-bit ids; the two-generation cache holds at most 2 * `keep` chunks."""

    def __init__(self, path: str, cached: bool = True, keep: int = 250_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.keep = keep
        self.cached = cached
        self.model, self.normalizer = self.tokenizer.model, self.tokenizer.normalizer
        self.alphabet = byte_alphabet()
        self.tails = _Cache(self._library)
        self.old: dict[str, bytes] = {}
        self.cache = _Cache(self._chunk)

    def _library(self, text: str) -> bytes:
        return pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _letters(self, word: str) -> bytes | None:
        if word.isascii():
            mapped = word.lower()
        else:
            if max(word) < LATIN_END and "\u0130" not in word:
                normal = word.lower()  # composed already, and lower-cased letter by letter
            else:
                normal = self.normalizer.normalize_str(word)
            if not normal.isalpha():
                return None
            mapped = normal.encode().decode("latin-1").translate(self.alphabet)
        return pack([t.id for t in self.model.tokenize(mapped)])

    def _chunk(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        if (found := self.old.get(chunk)) is not None:
            return found
        if len(chunk) <= 64:
            head = chunk.rstrip(TAIL)
            if head.isalpha() and (ids := self._letters(head)) is not None:
                return ids + self.tails[chunk[len(head) :]] if len(head) < len(chunk) else ids
        return self._library(chunk)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.cached:
            return self._library(text)
        if len(self.cache) > self.keep:
            self.old = dict(self.cache)
            self.cache = _Cache(self._chunk)
        if len(self.tails) > 10_000:
            self.tails.clear()
        chunks = text.replace("\n", " ").replace("\t", " ").split(" ")
        if len(chunks) <= self.keep:
            return b"".join(map(self.cache.__getitem__, chunks))
        parts = []
        for at in range(0, len(chunks), self.keep):
            parts.extend(map(self.cache.__getitem__, chunks[at : at + self.keep]))
            self.cache.clear()
        return b"".join(parts)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and vocabulary."""
    return Encoder(path)
