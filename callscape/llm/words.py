"""Words and word-sequence fingerprints of whole texts, computed on arrays.

Words are runs of bytes other than ASCII white space. Fingerprints are 64 bits
wide: a word's is a mixed polynomial of its bytes, a sequence's is combined
from those of its halves, so a window of any length costs a handful of array
operations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .shared import ASCII_SPACE

U64 = np.uint64
#: Bytes hashed at a time.
SEGMENT = 1 << 20


def _spaces() -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(ASCII_SPACE)] = True
    return out


IS_SPACE = _spaces()
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
_random = np.random.default_rng(20_177)
BYTE_VALUE = _random.integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)
STEP = 0x9E3779B97F4A7C15
STEP_BACK = pow(STEP, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) < n:
        out = np.full(max(n, 4096), base, dtype=U64)
        out[0] = 1
        with np.errstate(over="ignore"):
            _powers[base] = np.multiply.accumulate(out)
    return _powers[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser: every bit of the result depends on every bit of the input."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words of a byte array."""
    edge = np.diff(IS_SPACE[data].astype(np.int8), prepend=1, append=1)
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), dtype=U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SEGMENT, side="right")))
        base = starts[i]
        part = data[base : ends[j - 1]]
        sums = np.concatenate((np.zeros(1, U64), np.cumsum(BYTE_VALUE[part] * _power(STEP, len(part)), dtype=U64)))
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((sums[e] - sums[s]) * _power(STEP_BACK, len(part) + 1)[s] + (e - s).astype(U64))
        i = j
    return out


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * U64(0xD6E8FEB86659FD93) + b * U64(0xA0761D6478BD642F) + U64(0x632BE59BD9B4E019))


def sequences(words: np.ndarray, length: int) -> np.ndarray:
    """Fingerprint of every `length` consecutive words, by its start."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, U64)
    doubled, size, at, out = words, 1, 0, None
    rest = length
    while True:
        if rest & size:
            out = doubled[at : at + n] if out is None else join(out, doubled[at : at + n])
            at += size
            rest -= size
        if not rest:
            return mix(out + U64(length))
        doubled, size = join(doubled[:-size], doubled[size:]), size * 2


def hashed_batch(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Word fingerprints of all texts of an Arrow array, one after the other, and the place where each text's begin (and the end)."""
    texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32, len(texts) + 1, texts.offset * (8 if pa.types.is_large_string(texts.type) else 4))
    size = int(offsets[-1] - offsets[0])
    if not size:
        return np.empty(0, U64), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8, size, int(offsets[0]))
    cuts = offsets.astype(np.int64) - int(offsets[0])
    inside = np.zeros(size + 2, np.bool_)
    inside[1:-1] = ~IS_SPACE[data]
    begins, stops = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    whole = cuts[:-1] < cuts[1:]  # texts that are not empty are cut from their neighbours
    first, last = cuts[:-1][whole], cuts[1:][whole] - 1
    begins[first] = inside[1:-1][first]
    stops[last] = inside[1:-1][last]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    words = word_hashes(LOWER[data] if lower else data, starts, ends)
    return words, np.searchsorted(starts, cuts)


def windows_of(words: np.ndarray, cuts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all windows of `length` words within one text, and the place where each text's begin (and the end)."""
    counts = np.maximum(0, np.diff(cuts) - (length - 1))
    at = np.concatenate(([0], np.cumsum(counts)))
    every = sequences(words, length)
    if len(every) == at[-1]:
        return every, at
    return every[np.repeat(cuts[:-1] - at[:-1], counts) + np.arange(at[-1])], at
