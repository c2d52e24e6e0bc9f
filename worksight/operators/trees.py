"""Numpy helpers for the paths of rows through isolation trees."""

import numpy as np

#: A path as long as expected counts so many units.
UNIT = 1_000_000_000


def expected_path(n) -> np.ndarray:
    """Average path length of an unsuccessful search among n keys."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1) + np.euler_gamma) - 2.0 * (n[big] - 1) / n[big]
    return out


def path_units(rows: np.ndarray) -> np.ndarray:
    """What a row gains that ends in a node with so many sample rows: its depth and the path expected below,
    as a share of the path expected in the whole tree.  ``rows[tree, node]``, nodes numbered like a heap."""
    depth = np.floor(np.log2(np.maximum(np.arange(rows.shape[1]), 1)))
    whole = np.maximum(expected_path(rows.sum(axis=1)), 1e-12)[:, None]
    return np.rint((depth + expected_path(rows)) / whole * UNIT).astype(np.int64)


def total_units(feature: np.ndarray, split: np.ndarray, units: np.ndarray, depth: int, x: np.ndarray) -> np.ndarray:
    """Units of each row, added over all trees."""
    total, every = np.zeros(len(x), np.int64), np.arange(len(x))
    for t in range(len(feature)):
        at = np.ones(len(x), np.int64)
        for _ in range(depth):
            f = feature[t, at]
            goes_right = x[every, np.maximum(f, 0)] > split[t, at]
            at = np.where(f < 0, at, 2 * at + goes_right)
        total += units[t, at]
    return total
