"""Vectorised work on blocks of texts: code points, rolling hashes, sliding extremes, grouping by hash."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from ..functions.points import code_points, starts_of  # noqa: F401

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def gram_hashes(points: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A 64-bit hash of each run of n code points (len(points) - n + 1 of them)."""
    m = len(points) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    base = mix(np.array([seed], np.uint64))[0] | U64(1)
    p = points.astype(np.uint64) + U64(1)
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h *= base
        h += p[k : k + m]
    return mix(h)


def sliding(op: Callable[[np.ndarray, np.ndarray], np.ndarray], x: np.ndarray, width: int) -> np.ndarray:
    """op (minimum or maximum) over each window of the given width, in log2(width) passes."""
    size = 1
    while size * 2 <= width:
        x = op(x[:-size], x[size:])
        size *= 2
    return op(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def batch_of(columns: dict[str, tuple[np.ndarray, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in columns.values()], names=list(columns))


def group_starts(*keys: np.ndarray) -> np.ndarray:
    """First index of each group of equal neighbouring keys (the keys are sorted)."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)
