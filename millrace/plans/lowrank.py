"""Kernel matrices of more rows than one place holds, by their numerical rank.

Pivots are rows whose kernel columns span those of all rows: K = F F' up to TOL of the largest entry on the diagonal, which is checked on every row
(the rest of a pivoted Cholesky factor is positive semidefinite, so its diagonal bounds every entry). F's row of x is L^-1 k(pivots, x),
with L the Cholesky factor of the pivots' own matrix, so it is computed where x is. Smooth kernels in few dimensions have a rank of tens or hundreds, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.core import matrix_of
from millrace.storage import ship

#: Relative rest of the diagonal at which the factor counts as whole, pivots at most, and candidates that a partition sends in a pass.
TOL, MAX_RANK, CANDIDATES = 1e-11, 3_000, 64

Kernel = Callable[[np.ndarray, np.ndarray], np.ndarray]


def solve_lower(factor: np.ndarray, b: np.ndarray, block: int = 64) -> np.ndarray:
    """factor^-1 b for a lower triangular factor, block by block."""
    out = np.array(b, dtype=float)
    for at in range(0, len(factor), block):
        own = slice(at, at + block)
        out[own] = np.linalg.solve(factor[own, own], out[own] - factor[own, :at] @ out[:at])
    return out


class Factor:
    """The rows of F for given pivots."""

    def __init__(self, kernel: Kernel, pivots: np.ndarray, factor: np.ndarray) -> None:
        self.kernel, self.pivots, self.factor = kernel, pivots, factor

    def rows(self, x: np.ndarray) -> np.ndarray:
        if not len(self.pivots):
            return np.zeros((len(x), 0))
        return solve_lower(self.factor, self.kernel(self.pivots, x)).T

    def diagonal(self, x: np.ndarray) -> np.ndarray:
        return np.array([self.kernel(r[None], r[None])[0, 0] for r in x])

    def rest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What F leaves of the diagonal, and the diagonal."""
        whole = self.diagonal(x)
        return whole - (self.rows(x) ** 2).sum(axis=1), whole

    def grown(self, candidates: np.ndarray, least: float) -> Factor:
        """With pivots from the candidates, the one with the largest rest first, until all rests are below `least`."""
        rest = self.rest(candidates)[0]
        own, columns, picked = self.rows(candidates), [], []
        k = self.kernel(candidates, candidates) - own @ own.T
        while len(picked) < len(candidates) and len(self.pivots) + len(picked) < MAX_RANK:
            i = int(rest.argmax())
            if not rest[i] > least:
                break
            column = k[:, i] - (np.stack(columns, axis=1) @ np.array([c[i] for c in columns]) if columns else 0)
            column = column / np.sqrt(rest[i])
            columns.append(column)
            picked.append(i)
            rest = rest - column**2
            rest[picked] = -np.inf
        if not picked:
            return self
        m, n = len(self.pivots), len(picked)
        factor = np.zeros((m + n, m + n))
        factor[:m, :m], factor[m:, :m] = self.factor, own[picked]
        factor[m:, m:] = np.tril(np.stack(columns, axis=1)[picked])
        return Factor(self.kernel, np.concatenate((self.pivots, candidates[picked])), factor)


def kernel_factor(rows: DataFrame, width: int, kernel: Kernel) -> Factor:
    """The factor for rows (x): each pass, over all of them, brings the rows that the pivots so far leave most of."""
    ship(rows.sparkSession)
    found = Factor(kernel, np.zeros((0, width)), np.zeros((0, 0)))
    while True:
        def run(batches: Iterator[pa.RecordBatch], own: Factor = found) -> Iterator[pa.RecordBatch]:
            best: dict[tuple, float] = {}
            top = 0.0
            for whole in batches:
                for at in range(0, len(whole), 2048):
                    x = np.unique(matrix_of(whole.column(0).slice(at, 2048), width), axis=0)
                    rest, full = own.rest(x)
                    top = max(top, float(full.max(initial=0.0)))
                    for i in np.argsort(-rest, kind="stable")[:CANDIDATES]:
                        best[tuple(x[i])] = float(rest[i])
                    best = dict(sorted(best.items(), key=lambda item: -item[1])[:CANDIDATES])
            if best:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([list(k) for k in best], pa.list_(pa.float64())), pa.array(list(best.values())), pa.array([top] * len(best))], names=["x", "rest", "top"])

        sent = rows.select("x").mapInArrow(run, "x array<double>, rest double, top double")
        # CANDIDATES of each partition; of all of them the first few hundred
        best = sent.orderBy(F.desc("rest"), "x").limit(8 * CANDIDATES).collect()
        if not best:
            raise ValueError("there are no rows to fit on")
        top = max(r.top for r in best)
        if best[0].rest <= TOL * top:
            return found
        before = len(found.pivots)
        found = found.grown(np.unique(np.array([r.x for r in best]), axis=0), max(TOL * top / 4, best[0].rest * 1e-4))
        if len(found.pivots) >= MAX_RANK:
            raise ValueError(f"the kernel matrix of these rows has a rank of over {MAX_RANK}: more rows than fit in one place need a smoother kernel")
        if len(found.pivots) == before:
            return found
