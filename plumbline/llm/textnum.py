"""Words of whole texts as NumPy arrays, straight from Arrow's string buffers.

A block holds the words of a run of documents: where each starts and ends in the bytes, and a 64-bit hash of its
content. All of it is vectorised over the block; blocks are cut between documents once they have ``BLOCK_BYTES``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
BLOCK_BYTES = 1 << 21

_rng = np.random.default_rng(20240229)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
STEP_CODE = _rng.integers(1, 2**63, 4096, dtype=np.uint64) * U(2) + U(1)
_base = U(0x9E3779B97F4A7C15 | 1)
_powers = np.cumprod(np.full(1 << 12, _base, dtype=np.uint64))

#: Bytes of words: all but ASCII white space; and lower-case letters, digits and what is not ASCII (A-Z lower-cased).
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
AS_IS = np.arange(256, dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> np.ndarray:
    global _powers
    if n > len(_powers):
        _powers = np.cumprod(np.full(1 << int(n - 1).bit_length(), _base, dtype=np.uint64))
    return _powers


@dataclass
class Block:
    """Documents ``rows`` of a batch: bytes, and words by start, end (in ``data``) and hash; ``first[i]:first[i + 1]`` are document i's words."""

    rows: slice
    data: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.n_words)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if at is not None and len(column) else np.zeros(len(column) + 1, dtype=np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)), offsets


def spans(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and each document's first word; words end at a document's bounds."""
    mask = inside[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[bounds] = True
    begins, stops = mask.copy(), mask.copy()
    if len(data):
        begins[1:] &= ~mask[:-1] | edge[1:-1]
        stops[:-1] &= ~mask[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs, after ``fold``; equal content has equal hashes wherever it stands."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    sizes = ends - starts
    before = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(before, sizes)
    values = BYTE_CODE[fold][data[place + np.repeat(starts, sizes)]] * powers(int(sizes.max()))[place]
    return mix(np.add.reduceat(values, before) ^ (sizes.astype(np.uint64) * U(0xD6E8FEB86659FD93)))


def blocks(column: pa.Array, inside: np.ndarray, fold: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    data, offsets = buffers(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        own, bounds = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, first = spans(own, bounds, inside)
        yield Block(slice(i, j), own, bounds, starts, ends, first, word_hashes(own, starts, ends, fold))
        i = j


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k words that begin at each word, over the whole block (those that cross into the next document too)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out += hashes[j : j + n] * STEP_CODE[j]
    return mix(out)


def whole(first: np.ndarray, k: int) -> np.ndarray:
    """Which of the block's k-word runs lie in one document; of as many as ``grams`` gives."""
    n = int(first[-1]) - k + 1
    ok = np.ones(max(n, 0), dtype=bool)
    for b in range(1, k):
        cut = first[1:-1] - b
        ok[cut[(cut >= 0) & (cut < len(ok))]] = False
    return ok
