"""A filter of fixed size that tells which 64-bit names may be among many."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def _places(names: np.ndarray, size: int) -> np.ndarray:
    """Two of the ``size`` bits of the filter for each name."""
    x = names.view(np.uint64)
    y = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return np.stack([x, y]) >> np.uint64(65 - size.bit_length())


def filter_of(names: DataFrame, size: int, tasks: int = 16) -> np.ndarray:
    """Which bits the names of the first column set: ``size`` of them (a power of two), whatever the names; ``tasks`` such arrays reach the driver, one by one."""

    def task(batches):
        bits = np.zeros(size, bool)
        for b in batches:
            bits[_places(b.column(0).to_numpy(), size).ravel()] = True
        yield pa.record_batch([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    total = np.zeros(size // 8, np.uint8)
    for r in names.coalesce(tasks).mapInArrow(task, "bits binary").toLocalIterator():
        total |= np.frombuffer(r["bits"], np.uint8)
    return total


def may_hold(bits: np.ndarray, names: np.ndarray) -> np.ndarray:
    """False for names that are not in the filter; true for those that are, and for some others."""
    at = _places(names, len(bits) * 8)
    return ((bits[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1).all(axis=0)
