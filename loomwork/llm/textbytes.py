"""Words, lines and their 64-bit hashes in columns of text, found with array operations on the UTF-8 bytes.

A byte string b hashes to sum(TABLE[b[i]] * P**i) modulo 2**64, mixed. Running sums over a whole slice give the hash
of any span in a few operations, so no Python code runs for each row, line or word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
P = 0x9E3779B97F4A7C15
#: Bytes of text that are worked on at once; a longer text is a slice of its own.
SLICE_BYTES = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser for 64-bit hashes."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


TABLE = mix(np.arange(1, 257, dtype=U64) * U64(P)) | U64(1)


@lru_cache(maxsize=1)
def _powers(log_size: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and its inverse for i below 2**log_size."""
    both = []
    for base in (P, pow(P, -1, 1 << 64)):
        x = np.full(1 << log_size, base, U64)
        x[0] = 1
        both.append(np.cumprod(x))
    return both[0], both[1]


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) over the rows of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


class Hashes:
    """Hashes of spans of one slice."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        power, self.inverse = _powers(max(20, (n + 1).bit_length()))
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(TABLE[data] * power[:n], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts])


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text) of the maximal runs of true bytes within each text."""
    n = len(inside)
    if not n:
        none = np.empty(0, np.int64)
        return none, none, none
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begins = inside & (first[:-1] | ~np.concatenate(([False], inside[:-1])))
    closes = inside & (first[1:] | ~np.concatenate((inside[1:], [False])))
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


#: White space by the contracts: blank and 9 to 13.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: Letters and digits of ASCII, and every byte of other characters.
WORD_BYTES = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """UTF-8 with the capitals of ASCII and Latin-1 as small letters; no character changes its length."""
    out = LOWER[data]
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    second = second[(data[second] >= 0x80) & (data[second] <= 0x9E) & (data[second] != 0x97)]
    out[second] += 0x20
    return out
