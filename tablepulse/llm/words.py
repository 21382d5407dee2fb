"""Words and hashes of words for whole Arrow batches of texts, in numpy.

Words are maximal runs of bytes that a table of 256 flags does not call separators. UTF-8 keeps ASCII
bytes apart from all others, so classes of ASCII characters can be told byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of a batch that are hashed at a time.
SEGMENT = 1 << 20

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: All ASCII but digits and letters; upper-case letters are letters once folded.
MARKS = np.zeros(256, bool)
MARKS[:0x80] = True
MARKS[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = False

_rng = np.random.default_rng(20240229)
_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUES[ord("A") : ord("Z") + 1] = _VALUES[ord("a") : ord("z") + 1]
_PLACES = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    if not _powers:
        mask = (1 << 64) - 1
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            out = np.ones(SEGMENT + 1, np.uint64)
            filled, step = 1, base
            while filled <= SEGMENT:
                n = min(filled, SEGMENT + 1 - filled)
                out[filled : filled + n] = out[:n] * np.uint64(step)
                filled, step = filled + n, step * step & mask
            _powers.append(out)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the input reaches every bit of the output."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and where each begins (one more at the end). Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.fill_null("").cast(pa.large_string())
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def bounds(data: np.ndarray, at: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word in ``data``, and where the words of each text begin among them."""
    inside = ~separator[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = at[1:] > at[:-1]
    begin, end = at[:-1][full], at[1:][full] - 1
    first[begin], last[end] = inside[begin], inside[end]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, at)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, separator: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, A-Z folded to a-z."""
    power, back = _power_tables()
    values = np.where(separator, np.uint64(0), _VALUES)
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = int(np.searchsorted(ends, starts[i] + SEGMENT, "right"))
        if j <= i:  # one word longer than a segment
            out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes().lower(), digest_size=8).digest(), "little")
            i += 1
            continue
        low = int(starts[i])
        part = values[data[low : ends[j - 1]]]
        part *= power[: len(part)]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part, out=total[1:])
        out[i:j] = mix((total[ends[i:j] - low] - total[starts[i:j] - low]) * back[starts[i:j] - low])
        i = j
    return out


def word_hashes(column: pa.Array | pa.ChunkedArray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts end to end, and where each text's begin."""
    data, at = utf8(column)
    starts, ends, word_at = bounds(data, at, separator)
    return hashes(data, starts, ends, separator), word_at


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words; fewer words, but not none: of the whole."""
    n = len(h)
    if not n:
        return np.zeros(0, np.uint64)
    if n < size:
        return mix((h * _PLACES[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n * 0x1234567))
    out = h[: n - size + 1] * _PLACES[0]
    for k in range(1, size):
        out += h[k : n - size + 1 + k] * _PLACES[k]
    return np.unique(mix(out))


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts hold about ``most`` bytes at most, or are one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = utf8(batch[text])
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j
