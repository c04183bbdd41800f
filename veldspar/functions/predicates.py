"""Boxes: one closed interval per attribute, joined by AND or OR."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def interval(value: Column, low: Column, high: Column) -> Column:
    """Closed; a null value is in no interval, a null bound is open to its side."""
    return value.isNotNull() & (low.isNull() | (value >= low)) & (high.isNull() | (value <= high))


def box(attributes: int, *, any_: bool = False, value: str = "a", low: str = "l", high: str = "r") -> Column:
    """a0 in [l0, r0] and a1 in [l1, r1] ..., or at least one of them."""
    parts = [interval(F.col(f"{value}{j}"), F.col(f"{low}{j}"), F.col(f"{high}{j}")) for j in range(attributes)]
    return reduce((lambda x, y: x | y) if any_ else (lambda x, y: x & y), parts)


def in_box(values: np.ndarray, low: np.ndarray, high: np.ndarray, *, any_: bool = False) -> np.ndarray:
    """The same over rows of attribute values; NaN stands for null."""
    inside = ~np.isnan(values) & (np.isnan(low) | (values >= low)) & (np.isnan(high) | (values <= high))
    return inside.any(axis=1) if any_ else inside.all(axis=1)
