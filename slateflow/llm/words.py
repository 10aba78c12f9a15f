"""Words and shingles of whole texts as 64-bit hashes, computed in numpy over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text hashed at a time, at some 60 bytes of working memory each, and bytes taken out as Python strings at a time; a longer text is worked on alone.
SLICE, TEXTS = 1 << 18, 1 << 20

_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE, _INVERSE_MOD = 0x9E3779B97F4A7C15 | 1, 1 << 64
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Powers:
    """Powers of the base and of its inverse, grown as longer texts come."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, SLICE + 1)
            self.up, self.down = _powers(_BASE, n), _powers(pow(_BASE, -1, _INVERSE_MOD), n)
        return self.up, self.down


_POWERS = _Powers()


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def word_hashes(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, row offsets into them) for runs of rows that fill about ``SLICE`` bytes."""
    raw, off = text_buffer(column)
    row, n = 0, len(off) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(off, off[row] + SLICE, "right")) - 1)
        yield row, *_hash_slice(raw[off[row] : off[end]], off[row : end + 1] - off[row])
        row = end


def text_slices(column: pa.Array) -> Iterator[list[str]]:
    """The texts of a column in runs of rows that fill about ``TEXTS`` bytes; null is empty."""
    _, off = text_buffer(column)
    row, n = 0, len(off) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(off, off[row] + TEXTS, "right")) - 1)
        yield [t or "" for t in column.slice(row, end - row).to_pylist()]
        row = end


def _hash_slice(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    inside = ~_SPACE[data]
    fresh = np.zeros(n + 1, bool)  # a row begins here
    fresh[off] = True
    starts = np.flatnonzero(inside & (fresh[:n] | ~np.concatenate(([False], inside[:-1]))))
    ends = np.flatnonzero(inside & (fresh[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    up, down = _POWERS.get(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
    hashes = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, off).astype(np.int64)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` successive words."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, n, np.uint64)
    for j in range(n):
        out = out * _STEP + words[j : j + m]
    return mix64(out)


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-word shingles; fewer words make one shingle, none make none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(grams(words, n if len(words) >= n else len(words)))


def documents_words(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, word hashes) of every row."""
    for first, words, off in word_hashes(column):
        for i in range(len(off) - 1):
            yield first + i, words[off[i] : off[i + 1]]


def list_column(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column from one numpy array per row."""
    off = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=off[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat.view(np.int64) if flat.dtype == np.uint64 else flat).cast(kind))
