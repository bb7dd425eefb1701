"""Arrow and numpy helpers for embedding columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

DIM = 64


def vector_key(col: str | Column) -> Column:
    """64-bit key of an embedding; exact copies share it."""
    return F.xxhash64(col)


def looks_usable(col: str, dim: int = DIM) -> Column:
    """Exactly ``dim`` finite numbers that are not all zero (null elements are no numbers)."""
    finite = F.forall(
        col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return F.coalesce(
        (F.size(col) == dim) & finite & F.exists(col, lambda x: x != F.lit(0.0)), F.lit(False)
    )


def usable_rows(column: pa.Array, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the usable lists in ``column`` and their values, one row each."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == dim)
    if not len(at):
        return at, np.empty((0, dim), np.float32)
    values = column.take(pa.array(at)).flatten()
    if values.null_count:
        values = values.fill_null(float("nan"))
    rows = values.to_numpy(zero_copy_only=False).reshape(-1, dim)
    good = np.isfinite(rows).all(1) & (rows != 0).any(1)
    return at[good], rows[good]


def pack(rows: np.ndarray) -> pa.Array:
    """Float32 rows as one binary value each."""
    rows = np.ascontiguousarray(rows, dtype=np.float32)
    width = rows.shape[1] * 4
    if len(rows) * width >= 2**31:
        raise ValueError("batch of vectors too large for one binary column")
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(
        pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)]
    )


def unpack(column: pa.ChunkedArray | pa.Array, dim: int = DIM) -> np.ndarray:
    """Rows packed by :func:`pack`."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts = []
    for c in chunks:
        if not len(c):
            continue
        offsets = np.frombuffer(c.buffers()[1], np.int32, len(c) + 1, c.offset * 4)
        start, stop = int(offsets[0]), int(offsets[-1])
        parts.append(np.frombuffer(c.buffers()[2], np.float32, (stop - start) // 4, start))
    if not parts:
        return np.empty((0, dim), np.float32)
    return np.concatenate(parts).reshape(-1, dim)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double."""
    wide = rows.astype(np.float64)
    # two steps, so that very large or small values neither overflow nor vanish
    wide /= np.abs(wide).max(axis=1, keepdims=True)
    wide /= np.sqrt(np.einsum("ij,ij->i", wide, wide))[:, None]
    return wide
