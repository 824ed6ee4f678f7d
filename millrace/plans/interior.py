"""The optimum of a kernel machine's dual by a primal-dual interior point method over rows that stay where they are.

A step is a Newton step on the conditions of the optimum. With K = F F' it needs the sums of F' D^-1 F over the rows, r x r numbers for a factor of r columns;
the rows' coefficients and multipliers are a table that each step writes anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.core import matrix_of, wide_sums
from millrace.plans.lowrank import Factor
from millrace.storage import cut, ship

STEPS = 120
_STATE = ["a", "z", "q", "da", "dz", "dq"]


def dual_optimum(groups: DataFrame, width: int, factor: Factor, c: float, tol: float) -> tuple[np.ndarray, float, DataFrame]:
    """(w, bias, (x, y, alpha)) for groups (x, y, n) of n equal rows with labels -1 and 1; a row's coefficient is at most c.

    z and q are the multipliers of a >= 0 and a <= n c; it ends when a row with a coefficient off either end meets its condition to within tol / 100.
    """
    ship(groups.sparkSession)
    r = len(factor.pivots)
    start = [(F.col("n") * c / 2).alias("a"), F.lit(1.0).alias("z"), F.lit(1.0).alias("q"), *[F.lit(0.0).alias(v) for v in _STATE[3:]]]
    table = cut(groups.select("x", F.array("y", "n", *start).alias("s")), "dual")

    def parts(x: np.ndarray, s: np.ndarray, step: float):
        y, n = s[:, 0], s[:, 1]
        a, z, q = (s[:, 2 + k] + step * s[:, 5 + k] for k in range(3))
        return y, n * c - a, a, z, q, y[:, None] * factor.rows(x)

    def wanted(v, y, room, a, z, q, w, bias):
        """D, and the right side as its fixed part and the part that the barrier scales."""
        miss = -(v @ w - 1 + bias * y - z + q)
        return z / a + q / room, miss - z + q, 1 / a - 1 / room

    both, step, bias = F.concat("x", "s"), 0.0, 0.0
    first = wide_sums(table, both, r + 1, lambda m: np.append((lambda y, room, a, z, q, v: v.T @ a)(*parts(m[:, :width], m[:, width:], 0.0)), len(m)))
    w, total = first[:-1], first[-1]
    shrink = 0.3
    for _ in range(STEPS):
        def work(m: np.ndarray) -> np.ndarray:
            out = np.zeros(r * r + 3 * r + 6)
            for at in range(0, len(m), 4096):
                x, s = m[at : at + 4096, :width], m[at : at + 4096, width:]
                y, room, a, z, q, v = parts(x, s, step)
                d, fixed, barrier = wanted(v, y, room, a, z, q, w, bias)
                vd = v / d[:, None]
                own = [(vd.T @ v).ravel(), vd.T @ y, vd.T @ fixed, vd.T @ barrier]
                out += np.concatenate([*own, [(y * y / d).sum(), (y * fixed / d).sum(), (y * barrier / d).sum(), (y * a).sum(), (z * a + q * room).sum(), np.abs(fixed + z - q).sum()]])
            return out

        sums = wide_sums(table, both, r * r + 3 * r + 6, work)
        m, (k, g0, g1), (yy, t0, t1, ya, gap, miss) = sums[: r * r].reshape(r, r), sums[r * r : -6].reshape(3, r), sums[-6:]
        mu = gap / (2 * total)
        if mu < 1e-8 * tol and miss < 1e-2 * tol * total and abs(ya) < 1e-6:
            break
        mu *= shrink
        inner = np.linalg.cholesky(m + np.eye(r))
        solved = np.linalg.solve(inner.T, np.linalg.solve(inner, np.stack([g0 + mu * g1, k], axis=1)))
        # y'da = -y'a, with da = D^-1 (h - V u - y db) and u = solved[0] - solved[1] db
        db = (t0 + mu * t1 - k @ solved[:, 0] + ya) / (yy - k @ solved[:, 1])
        u = solved[:, 0] - solved[:, 1] * db

        def move(batches: Iterator[pa.RecordBatch], step=step, w=w, bias=bias, mu=mu, u=u, db=db) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch):
                    continue
                x, s = matrix_of(batch.column(0), width), matrix_of(batch.column(1), 8)
                y, room, a, z, q, v = parts(x, s, step)
                d, fixed, barrier = wanted(v, y, room, a, z, q, w, bias)
                da = (fixed + mu * barrier - v @ u - y * db) / d
                dz, dq = (mu - z * da) / a - z, (mu + q * da) / room - q
                new = np.stack([y, s[:, 1], a, z, q, da, dz, dq], axis=1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    ends = [np.where(move < 0, -at / move, np.inf).min() for at, move in ((a, da), (room, -da), (z, dz), (q, dq))]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(new) + 1, dtype=np.int32) * 8), pa.array(new.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(np.full(len(new), min(ends)))], names=["x", "s", "end"])

        table = cut(table.select("x", "s").mapInArrow(move, "x array<double>, s array<double>, end double"), "dual")
        step = min(1.0, 0.99 * table.agg(F.min("end")).first()[0])
        shrink = 0.1 if step > 0.9 else 0.3 if step > 0.5 else 0.8
        w, bias = w + step * u, bias + step * db
    else:
        raise ValueError(f"the interior point method has not met tol in {STEPS} steps")
    alpha = (F.get("s", F.lit(2)) + step * F.get("s", F.lit(5))) / F.get("s", F.lit(1))
    return w, float(bias), table.select("x", F.get("s", F.lit(0)).alias("y"), alpha.alias("alpha"))
