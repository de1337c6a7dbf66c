"""Second moments of random codes for a symmetric chain: growth of pairs of replicas, and the distortion up to which the simple rate holds.

The chain on ``a`` symbols stays with probability 1 - p and moves to each other symbol alike; distortion counts wrong symbols.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def chain(a: int, p: float) -> np.ndarray:
    return np.full((a, a), p / (a - 1)) + np.eye(a) * (1 - p - p / (a - 1))


def invariant(a: int) -> np.ndarray:
    """Triples of symbols (rows) by which of them are equal (columns)."""
    x, y, z = np.meshgrid(*[np.arange(a)] * 3, indexing="ij")
    pattern = ((x == y) * 4 + (x == z) * 2 + (y == z)).ravel()
    return (pattern[:, None] == np.unique(pattern)).astype(float)


def replica_matrix(a: int, p: float, eta: np.ndarray) -> np.ndarray:
    """Moves of (source, replica, conjugate replica), a matrix for each eta: both replicas move as the source does; one that ends beside the source pays eta."""
    t, off = chain(a, p), 1 - np.eye(a)
    pay = np.where(off, eta[:, None, None], 1)
    return np.einsum("ac,bd,xy,nyc,nyd->nxabycd", t, t, 1 / t, pay, pay.conj()).reshape(len(eta), a**3, a**3)


def ratios(a: int, p: float, d: float, angles: np.ndarray) -> np.ndarray:
    """How far the growth g of pairs at each angle s stays below one: (1 - g) / (d (1 - d) (1 - cos s))."""
    b = a - 1
    e = d / (b * (1 - d)) * np.exp(1j * np.concatenate([[0.0], angles]))
    scale = b * d * e + d - b
    eta = (scale + b * (1 - e)) / scale
    u = invariant(a)
    small = np.linalg.solve(u.T @ u, u.T) @ replica_matrix(a, p, eta) @ u  # relabelled symbols move alike, so patterns move by themselves
    grows = np.abs(scale / scale[0]) ** 2 * np.abs(np.linalg.eigvals(small)).max(axis=1)
    return (1 - grows[1:]) / (d * (1 - d) * (1 - np.cos(angles)))


def simple_up_to(a: int, p: float, steps: int = 2000) -> float:
    """Largest distortion at which the alternating word's product of two moves has real eigenvalues: a grid, then bisection."""
    t = chain(a, p)

    def real(d: np.ndarray) -> np.ndarray:
        keep = 1 - d * a / (a - 1)
        undo = (np.eye(a)[:2] / keep[:, None, None]) + ((1 - 1 / keep) / a)[:, None, None]
        both = (undo[:, 1, :, None] * t) @ (undo[:, 0, :, None] * t)
        return np.abs(np.linalg.eigvals(both).imag).max(axis=1) < 1e-9

    grid = np.arange(1, steps) / steps * (1 - 1 / a)
    first = np.flatnonzero(~real(grid))
    if not len(first):
        return float(1 - 1 / a)
    low, high = grid[first[0]] - grid[0], grid[first[0]]
    for _ in range(45):
        mid = (low + high) / 2
        low, high = (mid, high) if real(np.array([mid]))[0] else (low, mid)
    return float(low)


def thresholds(cases: DataFrame) -> DataFrame:
    """``cases`` (a int, p double) with d_max."""

    def run(batches):
        for b in batches:
            found = [simple_up_to(a, p) for a, p in zip(b.column("a").to_pylist(), b.column("p").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("p"), pa.array(found, pa.float64())], ["a", "p", "d_max"])

    return cases.select("a", "p").mapInArrow(run, "a int, p double, d_max double")


def margins(cases: DataFrame, parts: int = 4, angles: int = 48) -> DataFrame:
    """Smallest ratio over angles at each ``parts``-th of the largest simple distortion of ``cases`` (a int, p double)."""
    at = np.arange(1, angles + 1) / angles * np.pi

    def run(batches):
        for b in batches:
            rows = []
            for a, p in zip(b.column("a").to_pylist(), b.column("p").to_pylist()):
                most = simple_up_to(a, p)
                for k in range(1, parts):
                    r = ratios(a, p, most * k / parts, at)
                    rows.append((a, p, k, most * k / parts, float(r.min()), float(at[r.argmin()])))
            out = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_pydict({n: pa.array(v, t) for n, v, t in zip(("a", "p", "part", "d", "ratio", "angle"), out, (pa.int32(), pa.float64(), pa.int32(), pa.float64(), pa.float64(), pa.float64()))})

    return cases.select("a", "p").mapInArrow(run, "a int, p double, part int, d double, ratio double, angle double")
