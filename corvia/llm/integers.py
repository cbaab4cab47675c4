"""Vectors as exact integers: which rows take part, floors of scaled components, squared distances."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, functions as F

#: Components below this in magnitude have squared distances of up to 64 parts within 63 bits.
WIDE = 1 << 27


def usable(vector: str) -> Column:
    """The vector is not null and all its components are finite numbers."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & F.coalesce(fine, F.lit(False))


def floors(rows: list | np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of each component, scale a power of two: int64 where all are small, else Python's integers."""
    x = np.array(rows, dtype=np.float64)
    if not x.size or np.abs(x).max() < WIDE / scale:
        return np.floor(x * scale).astype(np.int64)
    big = [[math.floor(scale * c) if abs(c) < 1e200 else int(c) * scale for c in row] for row in x.tolist()]
    return np.array(big, dtype=object)


def narrow(*arrays: np.ndarray) -> bool:
    return all(a.dtype != object and (not a.size or int(np.abs(a).max()) < WIDE) for a in arrays)


def long_or_none(values) -> list[int | None]:
    """Integers of a long column; null for those that it cannot hold."""
    return [int(x) if -(1 << 63) <= int(x) < 1 << 63 else None for x in values]
