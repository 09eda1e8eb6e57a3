"""Checks and layout shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray | None]]:
    """Which rows hold a usable vector, and the vectors in double precision (None where not).

    Null vectors, empty ones, zero ones and those with null or non-finite
    components are not usable.
    """
    out: list[np.ndarray | None] = [None] * len(column)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    offsets = np.asarray(column.offsets, np.int64)
    flat = column.values
    holes = flat.is_null().to_numpy(zero_copy_only=False)
    values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.concatenate([[0], np.cumsum(holes | ~np.isfinite(values))])
    some = np.concatenate([[0], np.cumsum(values != 0)])
    a, b = offsets[:-1], offsets[1:]
    good = valid & (b > a) & (bad[b] == bad[a]) & (some[b] > some[a])
    for i in np.flatnonzero(good):
        out[i] = values[a[i] : b[i]]
    return good, out


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, by way of their largest component so that nothing overflows."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of all rows of ``a`` with all rows of ``b``."""
    a, b = (v / np.abs(v).max(axis=1, keepdims=True) for v in (a, b))
    length = [np.sqrt(np.einsum("ij,ij->i", v, v)) for v in (a, b)]
    return (a @ b.T) / (length[0][:, None] * length[1][None, :])
