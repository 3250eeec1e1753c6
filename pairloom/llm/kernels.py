"""Array kernels shared by the operators: texts of an Arrow batch as bytes, words, shingles.

A word is a maximal run of bytes other than space and 0x09-0x0D. Every kernel works on a
slice of a batch of bounded size, so memory does not follow the batch or the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
SHINGLE = 5
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def unit(h: np.ndarray) -> np.ndarray:
    """Hashes as doubles in the open interval (0, 1)."""
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def byte_codes(fold_case: bool) -> np.ndarray:
    """A random 64-bit code for each byte; A-Z share the codes of a-z when folding case."""
    table = mix(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER)
    if fold_case:
        table[65:91] = table[97:123]
    return table


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and the n+1 offsets of the texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(
    batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES, rows: int | None = None
) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with at most ``limit`` bytes of text, or one longer text alone.

    ``rows`` bounds the texts of a range too, for work that has a fixed size a text.
    """
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
    first, n = 0, batch.num_rows
    while first < n:
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + limit, side="right")))
        last = min(last, first + rows) if rows else last
        yield batch.slice(first, last - first)
        first = last


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the n+1 offsets of the texts among the words."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    blank = np.zeros(256, bool)
    blank[[32, *range(9, 14)]] = True
    inside = ~blank[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, inside[:-1]
    before[edge[:-1]] = False
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, inside[1:]
    after[edge[1:]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(
    data: np.ndarray, at: np.ndarray, fold_case: bool = True
) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, and the offsets of the texts among the words."""
    starts, ends, of_text = word_bounds(data, at)
    if not len(starts):
        return np.zeros(0, np.uint64), of_text
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum()), dtype=np.int64) - np.repeat(first, sizes)
    letters = data[place + np.repeat(starts, sizes)]
    weights = powers(np.uint64(0xD6E8FEB86659FD93), int(sizes.max()))
    sums = np.add.reduceat(byte_codes(fold_case)[letters] * weights[place], first)
    return mix(sums + sizes.astype(np.uint64) * _MULTIPLIER), of_text


def shingles(
    words: np.ndarray, of_text: np.ndarray, size: int = SHINGLE
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, and the offsets of the texts among them.

    A text of one to ``size`` - 1 words has one shingle of all its words; a text without words
    has none.
    """
    counts = np.diff(of_text)
    made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_at = np.concatenate([[0], np.cumsum(made)])
    if not out_at[-1]:
        return np.zeros(0, np.uint64), out_at
    weights = powers(np.uint64(0xC2B2AE3D27D4EB4F), size)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    sums = np.zeros(len(words), np.uint64)
    for j in range(size):
        sums += padded[j : j + len(words)] * weights[j]
    text = np.repeat(np.arange(len(counts)), made)
    place = of_text[:-1][text] + np.arange(int(out_at[-1])) - out_at[:-1][text]
    out = sums[place]
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        own = words[of_text[i] : of_text[i + 1]]
        out[out_at[i]] = np.sum(own * weights[: len(own)], dtype=np.uint64) + np.uint64(len(own))
    return mix(out), out_at
