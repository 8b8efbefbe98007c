"""Vectors as exact integers: components scaled and rounded down, held as doubles that are whole numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Whole numbers below this are exact in a double, and so are sums and products that stay below it.
EXACT = 2.0**53
LONG = 2**63 - 1


def whole_parts(column: pa.Array, scale: float) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(components, row numbers, floor(scale * x) of those rows) for each length of vector.

    Rows that are null, or hold null or non-finite components or ones that are not finite once
    scaled, are left out.
    """
    size = np.array(pc.fill_null(column.value_lengths(), 0), np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        flat = np.floor(scale * flat) + 0.0
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    end = np.cumsum(size)
    fine = np.array(pc.is_valid(column)) & (bad[end] == bad[end - size])
    out = []
    for n in np.unique(size[fine]).tolist():
        rows = np.flatnonzero(fine & (size == n))
        out.append((n, rows, flat[(end - size)[rows][:, None] + np.arange(n)]))
    return out


def pack(x: np.ndarray) -> list[bytes]:
    """Rows as bytes: 16-bit integers where they hold the row, else doubles."""
    small = (np.abs(x).max(axis=1, initial=0) < 2**15).tolist()
    short = x.astype(np.int16) if all(small) else np.where(np.abs(x) < 2**15, x, 0).astype(np.int16)
    return [(short if s else x)[i].tobytes() for i, s in enumerate(small)]


def unpack(column: pa.Array, dim: int) -> np.ndarray:
    """The rows of ``pack``, as doubles."""
    out = np.empty((len(column), dim))
    if not dim:
        return out
    size = np.array(pc.binary_length(column))
    for kind in (np.int16, np.float64):
        rows = np.flatnonzero(size == dim * np.dtype(kind).itemsize)
        if len(rows):
            out[rows] = np.frombuffer(b"".join(column.take(pa.array(rows)).to_pylist()), kind).reshape(len(rows), dim)
    return out


def integers(x: np.ndarray) -> np.ndarray:
    """Whole doubles as Python's integers, which have no bound."""
    return np.array([int(v) for v in x.ravel().tolist()], object).reshape(x.shape)
