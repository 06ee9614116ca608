"""Vectorised word and n-gram hashes of Arrow string columns.

A slice of texts is hashed as one byte buffer: every byte adds a random value times a
power of an odd base, so that a word's (or n-gram's) hash is a difference of prefix sums,
brought to position 0 by the inverse power and mixed. No Python code runs per document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 18

U64 = np.uint64
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xC2B2AE3D27D4EB4F)
BYTE_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=U64)
_LOWER = BYTE_VALUES.copy()
_LOWER[ord("A") : ord("Z") + 1] = BYTE_VALUES[ord("a") : ord("z") + 1]
_IN_WORD = np.ones(256, bool)
_IN_WORD[[0x20, 9, 10, 11, 12, 13]] = False
#: 0 for separators, 1 for letters, digits and all bytes over 127, 2 for other signs.
_CLASS = np.where(_IN_WORD, 2, 0).astype(np.uint8)
for _range in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _CLASS[slice(*_range)] = 1
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    base &= (1 << 64) - 1
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        have = np.full(size, base, U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 2 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def ranges(values: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end] for many ranges."""
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(base, len(values)), out=total[1:])
    inverse = powers(pow(base, -1, 1 << 64), len(values) + 1)
    return mix((total[end] - total[start]) * inverse[start])


@dataclass
class Words:
    """The words of a slice of texts."""

    hashes: np.ndarray  #: uint64 for each word
    first: np.ndarray  #: for each text, the index of its first word; one more at the end
    start: np.ndarray  #: for each word, its first byte in data
    end: np.ndarray  #: and the byte after its last
    data: np.ndarray  #: all bytes of the slice

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def grams(self, n: int, key: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n words within a text, and the first word of each."""
        total = len(self.hashes)
        if total < n:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        ends = np.repeat(self.first[1:], self.counts)
        at = np.flatnonzero(np.arange(total) + n <= ends)
        return ranges(self.hashes, BASES[key], at, at + n), at

    def text_of(self, at: np.ndarray) -> np.ndarray:
        """For word positions, the number of their text in the slice."""
        return np.searchsorted(self.first, at, side="right") - 1


def split_words(texts: pa.Array, lower: bool = False, signs: bool = False) -> Words:
    """The words of texts; null is as empty. lower: A-Z count as a-z in the hashes.

    signs: runs of punctuation and other ASCII signs are words apart from letters and digits.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    if len(offsets) == 0 or raw is None:
        zero = np.zeros(0, np.int64)
        return Words(np.zeros(0, U64), np.zeros(len(texts) + 1, np.int64), zero, zero, np.zeros(0, np.uint8))
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    kind = _CLASS[data] if signs else _IN_WORD[data]
    inside = kind > 0
    begin, stop = inside.copy(), inside.copy()
    changes = kind[1:] != kind[:-1]
    begin[1:] &= changes
    stop[:-1] &= changes
    some = np.flatnonzero(np.diff(offsets) > 0)
    begin[offsets[some]] = inside[offsets[some]]
    stop[offsets[some + 1] - 1] = inside[offsets[some + 1] - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    hashes = ranges((_LOWER if lower else BYTE_VALUES)[data], BASES[0], start, end)
    return Words(hashes, np.searchsorted(start, offsets), start, end, data)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most limit bytes of text each, or one row."""
    sizes = pc.binary_length(batch.column(column).cast(pa.large_binary())).fill_null(0).cast(pa.int64()).to_numpy()
    total, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def first_of_runs(x: np.ndarray) -> np.ndarray:
    """Whether each value of a sorted array differs from the one before."""
    out = np.ones(len(x), bool)
    out[1:] = x[1:] != x[:-1]
    return out
