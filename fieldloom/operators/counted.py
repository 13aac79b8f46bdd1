"""Weighted counts of pixels by time around points: sums of a kernel times a sparse matrix (place by time and colour).

The matrix is held by the tasks, which share out the points by place. Pixels that are far from a cell of many points, beside
its size, are summed at the cell's Chebyshev grid instead of at its points, cell sizes falling as pixels are nearer; a
trial of some points and pixels comes first, and a kernel that the grid doesn't give to CLOSE is summed at the points.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

#: Chebyshev points each way; the most that a grid may be wrong by, as a share of each weight.
ORDER, CLOSE = 14, 1e-9
#: Pixels that share a leaf with a pixel, on average; the deepest leaves.
LEAF, DEEPEST = 400, 8
#: Places whose rows of the matrix are made dense at once (times columns); points that meet them at once.
DENSE, WIDE = 3_000_000, 1_000
_CHEB = np.cos((2 * np.arange(ORDER) + 1) * np.pi / (2 * ORDER))
_T = np.cos(np.outer(np.arange(1, ORDER), np.arccos(_CHEB)))


def _basis(at: np.ndarray) -> np.ndarray:
    return 1 / ORDER + 2 / ORDER * np.cos(np.outer(np.arccos(at.clip(-1, 1)), np.arange(1, ORDER))) @ _T


@dataclass
class Counts:
    """Rows of the matrix by place: columns (each once) and values of place i are those from starts[i] to starts[i + 1]."""

    x: np.ndarray
    y: np.ndarray
    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int
    box: tuple[float, float, float]  # the least x and y, and the side of a square that has all points and places
    depth: int

    def cells(self, x: np.ndarray, y: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        x0, y0, side = self.box
        return tuple(np.floor((c - o) / (side / 2**depth)).astype(np.int64).clip(0, 2**depth - 1) for c, o in ((x, x0), (y, y0)))

    def rows(self, own: np.ndarray) -> np.ndarray:
        """The matrix of these places, dense."""
        n = self.starts[own + 1] - self.starts[own]
        at = np.repeat(self.starts[own] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        out = np.zeros((len(own), self.width))
        out[np.repeat(np.arange(len(own)), n), self.columns[at]] = self.values[at]
        return out

    def sums(self, x: np.ndarray, y: np.ndarray, kernel: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """(points, columns): the kernel's sums of all places at the points."""
        out = np.zeros((len(x), self.width))
        leaf = self.cells(self.x, self.y, self.depth)
        weights = lambda px, py, own: kernel(np.sqrt((px[:, None] - self.x[own]) ** 2 + (py[:, None] - self.y[own]) ** 2))
        block = max(1, DENSE // self.width)

        def add(into: np.ndarray, px: np.ndarray, py: np.ndarray, own: np.ndarray, at: np.ndarray) -> None:
            for a in range(0, len(own), block):
                places = own[a : a + block]
                dense = self.rows(places)
                for b in range(0, len(px), WIDE):
                    few = slice(b, b + WIDE)
                    into[at[few]] += weights(px[few], py[few], places) @ dense

        def far(level: int, i: int, j: int, points: np.ndarray, own: np.ndarray) -> None:
            if not len(own):
                return
            if len(points) > ORDER * ORDER:
                h = self.box[2] / 2**level / 2
                cx, cy = self.box[0] + (2 * i + 1) * h, self.box[1] + (2 * j + 1) * h
                gx, gy = (g.ravel() for g in np.meshgrid(cx + h * _CHEB, cy + h * _CHEB, indexing="ij"))
                grid = lambda at: (_basis((x[at] - cx) / h)[:, :, None] * _basis((y[at] - cy) / h)[:, None, :]).reshape(len(at), -1)
                d = (self.x[own] - cx) ** 2 + (self.y[own] - cy) ** 2
                tried = np.unique(np.concatenate([np.argsort(d)[[0, len(d) // 2, -1]], np.linspace(0, len(d) - 1, 40).astype(int)]))
                some = points[np.unique(np.concatenate([[f(c[points]) for f in (np.argmin, np.argmax) for c in (x, y)], np.linspace(0, len(points) - 1, 12).astype(int)]))]
                want = weights(x[some], y[some], own[tried])
                if (np.abs(grid(some) @ weights(gx, gy, own[tried]) - want) <= CLOSE * np.abs(want)).all():
                    at_grid = np.zeros((len(gx), self.width))
                    add(at_grid, gx, gy, own, np.arange(len(gx)))
                    for b in range(0, len(points), WIDE):
                        out[points[b : b + WIDE]] += grid(points[b : b + WIDE]) @ at_grid
                    return
            add(out, x[points], y[points], own, points)

        def visit(level: int, i: int, j: int, points: np.ndarray, own: np.ndarray) -> None:
            """own are the places in the neighbours of the cell's parent."""
            a, b = (c[own] >> (self.depth - level) for c in leaf)
            near = (np.abs(a - i) <= 1) & (np.abs(b - j) <= 1)
            far(level, i, j, points, own[~near])
            own = own[near]
            if level == self.depth or len(points) * len(own) < 10_000:
                add(out, x[points], y[points], own, points)
                return
            a, b = self.cells(x[points], y[points], level + 1)
            for p, q in np.unique(np.stack([a, b], axis=1), axis=0).tolist():
                visit(level + 1, p, q, points[(a == p) & (b == q)], own)

        visit(0, 0, 0, np.arange(len(x)), np.arange(len(self.x)))
        return out


def depth_of(x: np.ndarray, y: np.ndarray, box: tuple[float, float, float]) -> int:
    """The least depth at which a place shares its leaf with LEAF others on average."""
    x0, y0, side = box
    for depth in range(DEEPEST):
        key = np.floor((x - x0) / (side / 2**depth)).astype(np.int64) * 2**20 + np.floor((y - y0) / (side / 2**depth)).astype(np.int64)
        if (np.unique(key, return_counts=True)[1].astype(float) ** 2).sum() <= LEAF * max(len(x), 1):
            return depth
    return DEEPEST
