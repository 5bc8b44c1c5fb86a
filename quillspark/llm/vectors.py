"""Reading vector columns from Arrow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def usable(vec) -> np.ndarray | None:
    """The vector in double precision; None if it is null, empty, zero or holds null or non-finite components."""
    if vec is None or not len(vec) or any(x is None for x in vec):
        return None
    v = np.asarray(vec, np.float64)
    return v if np.isfinite(v).all() and v.any() else None


def by_length(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """The usable vectors as matrices of doubles, one for each length: places in the column, values."""
    flat = column.flatten()
    if len(column) and not column.null_count and not flat.null_count:
        lengths = np.diff(column.offsets.to_numpy())
        if lengths[0] and (lengths == lengths[0]).all():
            x = flat.to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)
            good = np.flatnonzero(np.isfinite(x).all(axis=1) & x.any(axis=1))
            return [(good, x[good])] if len(good) else []
    found: dict[int, list] = {}
    for i, v in ((i, usable(x)) for i, x in enumerate(column.to_pylist())):
        if v is not None:
            found.setdefault(len(v), []).append((i, v))
    return [(np.array([i for i, _ in f], np.int64), np.stack([v for _, v in f])) for f in found.values()]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled first, so that neither squares nor sums leave the range of doubles."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def stored(df, column: str) -> str:
    """The numpy type that holds the column's components: single precision where the column has it."""
    return "<f4" if df.schema[column].dataType.elementType.typeName() == "float" else "<f8"
