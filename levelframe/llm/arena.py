"""Texts of an Arrow batch as one array of bytes, and hashes of their words and substrings, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd, so that it has an inverse modulo 2 ** 64: a substring's hash does not depend on where it stands.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text that are worked on at once; a longer text is a chunk of its own.
CHUNK = 1 << 20

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64; kept while they are short."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(n + 1, CHUNK + 2)
        have = np.full(size, base & 0xFFFFFFFFFFFFFFFF, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 4 * CHUNK:
            _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    b = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return b, o


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows with about limit bytes."""
    b, o = text_buffers(column)
    at, n = 0, len(o) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(o, o[at] + limit, "right")) - 1)
        end = min(end, n)
        yield at, end, b[o[at] : o[end]], o[at : end + 1] - o[at]
        at = end


def ascii_lowered(b: np.ndarray) -> np.ndarray:
    return np.where((b >= 65) & (b <= 90), b + np.uint8(32), b)


def word_bounds(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, number of the first word of each text and, last, of all words); words lie between blanks."""
    inside = ~((b == 32) | ((b >= 9) & (b <= 13)))
    cut = np.zeros(len(b) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside & (cut[:-1] | ~np.concatenate(([False], inside[:-1]))))
    ends = np.flatnonzero(inside & (cut[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class Prefix:
    """Prefix hashes of bytes: the hash of any substring in constant time."""

    def __init__(self, b: np.ndarray, base: int = BASE):
        inverse = BASE_INVERSE if base == BASE else pow(base, -1, 1 << 64)
        self.inverse = powers(inverse, len(b))
        self.sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers(base, len(b))[: len(b)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Equal substrings get equal values."""
        return (self.sums[ends] - self.sums[starts]) * self.inverse[starts]


def word_hashes(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, number of the first word of each text and, last, of all words)."""
    starts, ends, first = word_bounds(b, offsets)
    return mix(Prefix(b).of(starts, ends)), first
