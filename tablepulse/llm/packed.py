"""Sorted hashes in few bytes, and index arithmetic on ragged arrays."""

from __future__ import annotations

import numpy as np

LOW = np.uint64((1 << 48) - 1)


def pack48(sorted_values: np.ndarray) -> bytes:
    """Sorted 48-bit numbers: five bytes for each difference, or six for each number if one is too great."""
    steps = np.diff(sorted_values, prepend=np.uint64(0))
    width, values = (5, steps) if not len(steps) or int(steps.max()) < 1 << 40 else (6, sorted_values)
    return bytes([width]) + np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack48(data: bytes) -> np.ndarray:
    width = data[0]
    raw = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    values = out.reshape(-1).view("<u8").astype(np.uint64)
    return np.cumsum(values, dtype=np.uint64) if width == 5 else values


def ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For all i and low[i] <= j < high[i]: the i, and the j."""
    n = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(low)), n)
    out = np.repeat(low - (np.cumsum(n) - n), n)
    out += np.arange(len(out))
    return which, out
