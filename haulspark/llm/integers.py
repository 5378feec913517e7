"""Vectors as integers: floor(scale * component), whole vectors at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Integers of this size and more are refused: sums of their products would not fit a long.
TOO_LARGE = 1 << 27


def whole_vectors(column: pa.Array, scale: int) -> list[bytes | None]:
    """Each vector as int32 bytes; None for one that is null or holds a null or a component that is not finite."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out: list[bytes | None] = [None] * len(column)
    if not len(column):
        return out
    flat = column.flatten()  # of the vectors that are not null
    lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(), 0)
    ends = np.cumsum(lengths)
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null becomes nan
    good = np.isfinite(values)
    bad = np.concatenate([[0], np.cumsum(~good)])
    whole = np.floor(np.where(good, values, 0.0) * scale)
    fine = column.is_valid().to_numpy(zero_copy_only=False) & (bad[ends] == bad[ends - lengths])
    if (np.abs(whole) >= TOO_LARGE)[np.repeat(fine, lengths)].any():
        raise ValueError(f"components of {TOO_LARGE // scale} and more are too large for exact sums")
    whole = whole.clip(-TOO_LARGE, TOO_LARGE).astype(np.int32)
    for i in np.flatnonzero(fine).tolist():
        out[i] = whole[ends[i] - lengths[i] : ends[i]].tobytes()
    return out


def stacked(vectors: list[bytes], width: int) -> np.ndarray:
    """Vectors of one length as the rows of a matrix of doubles, which hold these integers exactly."""
    return np.frombuffer(b"".join(vectors), np.int32).reshape(len(vectors), width).astype(np.float64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` with those of ``b``, exact integers as doubles, or as int64 where doubles could round."""
    most = (np.abs(a).max(initial=0) + 1) * (np.abs(b).max(initial=0) + 1) * max(1, a.shape[1])
    if most < 1 << 52:
        return a @ b.T
    if most >= 1 << 62:
        raise ValueError("components are too large for exact sums")
    return a.astype(np.int64) @ b.astype(np.int64).T
