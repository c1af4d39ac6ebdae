"""Words, word hashes and shingles of Arrow text columns, computed on the raw UTF-8 bytes with numpy.

A text column is one byte buffer, so finding words, folding case and hashing are whole-buffer array steps; no Python
object is made per word. A word's hash is a polynomial over its bytes (prefix sums times an inverse power), mixed to
64 bits. Memory follows ``CHUNK`` bytes of text, or the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19  # bytes of text handled at a time
_P = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2^64
_P_INV = pow(_P, -1, 1 << 64)

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACES
#: letters, digits and every byte of a character outside ASCII
LETTERS = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        step = np.uint64(pow(base, done, 1 << 64))
        take = min(done, n - done)
        out[done : done + take] = out[:take] * step
        done += take
    return out


_tables: dict[int, np.ndarray] = {}


def powers(n: int, base: int) -> np.ndarray:
    have = _tables.get(base)
    if have is None or len(have) < n:
        have = _powers(max(n, CHUNK), base)
        if len(have) <= 4 * CHUNK:  # the table of one very long text is not kept
            _tables[base] = have
    return have[:n]


@dataclass
class Words:
    """The words of some consecutive rows: ``hash[first[i]:first[i + 1]]`` belong to row ``low + i``."""

    low: int
    first: np.ndarray
    hash: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.first) - 1


def text_chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets into them) of at most ``CHUNK`` bytes; a longer text stands alone. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8) if offsets[-1] else np.empty(0, np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + CHUNK, "right")) - 1)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def word_bounds(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words; a row's end also ends a word."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    word = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # rows begin here
    start = word.copy()
    start[1:] &= ~word[:-1] | edge[1:-1]
    end = word.copy()
    end[:-1] &= ~word[1:] | edge[1:-1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def words(column: pa.Array, inside: np.ndarray = NOT_SPACE) -> Iterator[Words]:
    """Hashes of the words, A-Z folded to lower case."""
    for low, _, data, offsets in text_chunks(column):
        start, end = word_bounds(data, offsets, inside)
        if len(start):
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * powers(len(data), _P), out=sums[1:])
            raw = (sums[end] - sums[start]) * powers(len(data), _P_INV)[start]
            hashed = mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        else:
            hashed = np.empty(0, np.uint64)
        yield Words(low, np.searchsorted(start, offsets), hashed)


def chain(hashes: np.ndarray, gaps: tuple[int, ...], salt: int = 0) -> np.ndarray:
    """Hash of the words at ``i + gap`` for every ``i`` where they exist; rows are not regarded."""
    n = len(hashes) - max(gaps)
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, (salt * 0xA24BAED4963EE407 + 0x9FB21C651E98DF25) % (1 << 64), np.uint64)
    for g in gaps:
        out = out * np.uint64(0x2545F4914F6CDD1D) + hashes[g : g + n]
    return mix(out)


def shingles(w: Words, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row; fewer words than ``size`` are one shingle, no word is none."""
    rolled = chain(w.hash, tuple(range(size)))
    for i in range(w.rows):
        a, b = w.first[i], w.first[i + 1]
        if b - a >= size:
            part = np.sort(rolled[a : b - size + 1])
            yield part[np.concatenate(([True], part[1:] != part[:-1]))]
        elif b > a:
            yield chain(w.hash[a:b], tuple(range(b - a)), salt=int(b - a))
        else:
            yield np.empty(0, np.uint64)
