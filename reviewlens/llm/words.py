"""Words of whole texts as hashes, computed for an Arrow batch at a time.

Both word definitions split at ASCII characters only, so UTF-8 bytes can be classified one by one:
no byte of a longer character is below 0x80. A word's 64-bit hash is a polynomial in its bytes,
taken from running sums, so a batch costs a few array passes however many words it has.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLOCK_BYTES = 1 << 20  # texts handled at once; a longer single text is a block of its own

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# [\x20\x09-\x0D] separates words.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
# [\x00-\x2F\x3A-\x60\x7B-\x7F] separates words: letters, digits and all beyond ASCII remain.
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits (a bijection)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = max(n, 2 * BLOCK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=U64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


class Words(NamedTuple):
    """Words of consecutive texts. ``first[i]:first[i + 1]`` are the words of text ``i``."""

    data: np.ndarray  # lower-cased bytes
    begin: np.ndarray  # byte places of the words
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.begin[i] : self.end[i]].tobytes()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 places where its texts begin; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[places[0] : places[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, places - places[0]


def find_words(raw: np.ndarray, places: np.ndarray, separators: np.ndarray = SPACES) -> Words:
    data = _LOWER[raw]
    n = len(data)
    inside = ~separators[data]
    edge = np.zeros(n + 1, bool)
    edge[places] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    begin = np.flatnonzero(inside & ~(before & ~edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & ~(after & ~edge[1:])) + 1
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
    hashes = mix((sums[end] - sums[begin]) * down[begin])
    return Words(data, begin, end, hashes, np.searchsorted(begin, places))


def blocks(column: pa.Array, separators: np.ndarray = SPACES) -> Iterator[tuple[int, int, Words]]:
    """(from row, to row, words) over a column, a bounded number of bytes at a time."""
    raw, places = utf8(column)
    n, at = len(places) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(places, places[at] + BLOCK_BYTES, side="right")) - 1)
        yield at, to, find_words(raw[places[at] : places[to]], places[at : to + 1] - places[at], separators)
        at = to


def shingle_sets(words: Words, size: int) -> list[np.ndarray]:
    """Each text's distinct shingles of ``size`` words, sorted; of fewer words, the whole sequence."""
    h, n = words.hash, len(words.hash)
    sets = []
    whole = max(0, n - size + 1)
    rolled = np.zeros(whole, U64)
    for k in range(size):
        rolled = mix(rolled + U64(k + 1)) + h[k : k + whole]
    rolled = mix(rolled)
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= size:
            sets.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            one = np.zeros(1, U64)
            for k in range(a, b):
                one = mix(one + U64(k - a + 1)) + h[k]
            sets.append(mix(one + U64(b - a)))
        else:
            sets.append(np.zeros(0, U64))
    return sets
