"""Sums over all pairs of points in the plane of a smooth function of their difference, in time that grows with the points.

The functions have the shape of 1 / (1 + d^2), whose waves fade like exp(-k): between nodes 1/15 apart, polynomials through 12 of them on each axis are right
to some 1e-10 of the function's largest value. So points are spread over the nodes around them, the nodes meet each other in one convolution, and its values
are read at the points. Spreading and reading are done where the rows are; only the lattice, whose size goes with the spread of the points and not with their number, is met as a whole.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache
from math import ceil, log2

import numpy as np

Function = Callable[[np.ndarray, np.ndarray], np.ndarray]

#: Largest distance of nodes, nodes that a point takes on an axis, and nodes of a lattice at most.
STEP, ORDER, MOST = 1 / 15, 12, 1 << 21

_NODES = np.arange(ORDER) - (ORDER // 2 - 1)
_SCALE = np.array([1 / np.prod((k - np.delete(_NODES, i)).astype(float)) for i, k in enumerate(_NODES)])


class Lattice:
    """Nodes in the plane, `step` apart; `low` is the number of the first on each axis, `origin` what has been taken off the points since they were spread."""

    def __init__(self, low: np.ndarray, shape: tuple[int, int], step: float) -> None:
        self.low, self.shape, self.step, self.origin = low, shape, step, np.zeros(2)

    @classmethod
    def around(cls, y: np.ndarray, step: float) -> Lattice:
        """The nodes that these points take."""
        low = np.floor(y.min(axis=0) / step) + _NODES[0]
        return cls(low.astype(np.int64), tuple(int(s) for s in np.floor(y.max(axis=0) / step) + _NODES[-1] + 1 - low), step)

    @property
    def fits(self) -> bool:
        return self.shape[0] * self.shape[1] <= MOST

    def _around(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(points, ORDER^2) places of the nodes around each point, and their weights."""
        y = (y + self.origin) / self.step
        at = np.floor(y)
        t = (y - at)[..., None] - _NODES
        before, after = np.ones_like(t), np.ones_like(t)
        np.cumprod(t[..., :-1], axis=-1, out=before[..., 1:])
        after[..., :-1] = np.cumprod(t[..., :0:-1], axis=-1)[..., ::-1]
        weight = before * after * _SCALE
        first = at.astype(np.int64) + _NODES[0] - self.low
        x, z = (first[:, axis, None] + np.arange(ORDER) for axis in (0, 1))
        places = x[:, :, None] * self.shape[1] + z[:, None, :]
        return places.reshape(len(y), -1), (weight[:, 0, :, None] * weight[:, 1, None, :]).reshape(len(y), -1)

    def spread(self, y: np.ndarray) -> np.ndarray:
        """The weight of the points on each node."""
        out = np.zeros(self.shape[0] * self.shape[1])
        for at in range(0, len(y), 4096):
            places, weight = self._around(y[at : at + 4096])
            out += np.bincount(places.ravel(), weight.ravel(), len(out))
        return out.reshape(self.shape)

    def read(self, values: list[np.ndarray], y: np.ndarray) -> np.ndarray:
        """(points, values) by interpolation."""
        out = np.empty((len(y), len(values)))
        for at in range(0, len(y), 4096):
            places, weight = self._around(y[at : at + 4096])
            for k, v in enumerate(values):
                out[at : at + 4096, k] = np.einsum("ij,ij->i", v.ravel()[places], weight)
        return out

    @property
    def _sizes(self) -> tuple[int, int]:
        return tuple(_fast(2 * s - 1) for s in self.shape)

    def waves(self, charges: np.ndarray) -> np.ndarray:
        """The charges as `met` and `convolved` take them."""
        return np.fft.rfft2(charges, self._sizes)

    def met(self, waves: np.ndarray, f: Function) -> float:
        """The sum of a function of the difference (x, y) over all pairs of charges, each with itself included."""
        power = waves.real**2 + waves.imag**2
        power[:, 1 : (self._sizes[1] + 1) // 2] *= 2  # waves of which only one of two is kept
        return float((power * _wave(f, self._sizes, self.step).real).sum()) / (self._sizes[0] * self._sizes[1])

    def convolved(self, waves: np.ndarray, *functions: Function) -> list[np.ndarray]:
        """For each function of a difference (x, y) its sum over all charges, on each node."""
        def one(f: Function) -> np.ndarray:
            both = _transform(f, self._sizes, self.step)
            both *= waves
            return np.ascontiguousarray(np.fft.irfft2(both, self._sizes)[: self.shape[0], : self.shape[1]])

        with ThreadPoolExecutor(len(functions)) as pool:
            return list(pool.map(one, functions))


def _transform(f: Function, sizes: tuple[int, int], step: float) -> np.ndarray:
    x, y = (np.fft.ifftshift(np.arange(s) - s // 2) * step for s in sizes)
    return np.fft.rfft2(f(x[:, None], y[None]))


@lru_cache(maxsize=1)
def _wave(f: Function, sizes: tuple[int, int], step: float) -> np.ndarray:
    return _transform(f, sizes, step)


def step_of(y: np.ndarray) -> float:
    """The distance of nodes for points spread like these: close where they are close, so that small differences are as right as large ones."""
    return min(STEP, float(np.ptp(y, axis=0).max()) / 64) or STEP


def charges_of(y: np.ndarray, step: float) -> tuple[Lattice, np.ndarray] | None:
    """The lattice that these points take and their weights on it; None if it is too wide."""
    lattice = Lattice.around(y, step)
    return (lattice, lattice.spread(y)) if lattice.fits else None


def together(parts: list[tuple[Lattice, np.ndarray] | None]) -> tuple[Lattice, np.ndarray] | None:
    """The charges of all parts, of one step, on one lattice."""
    if any(part is None for part in parts):
        return None
    low = np.min([own.low for own, _ in parts], axis=0)
    high = np.max([own.low + own.shape for own, _ in parts], axis=0)
    lattice = Lattice(low, tuple(int(s) for s in high - low), parts[0][0].step)
    if not lattice.fits:
        return None
    sums = np.zeros(lattice.shape)
    for own, charges in parts:
        x, z = own.low - low
        sums[x : x + own.shape[0], z : z + own.shape[1]] += charges
    return lattice, sums


def _fast(least: int) -> int:
    """A number of at least `least` whose prime factors are 2, 3 and 5."""
    return min(odd << max(0, ceil(log2(least / odd))) for odd in (1, 3, 5, 9, 15))
