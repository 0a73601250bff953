"""Slow modes of large elastic networks: springs as a list, block factors along the graph's levels, block Lanczos.

No 3n x 3n matrix is made. Nodes are taken level by level of a breadth-first walk, so springs join neighbouring levels
alone and the stiffness is block-tridiagonal: its factors hold some 9 n times the widest level's size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from axisframe.operators.ensemble import ZERO_MODE

#: The largest residual of a mode that is given out, against the larger of one and its eigenvalue.
MOST_RESIDUAL = 1e-7
#: The shift that makes the stiffness definite, against its mean diagonal.
_SHIFT = 1e-6


def near_pairs(points: np.ndarray, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs i < j of points at most ``cutoff`` and more than 1e-6 apart, met in cells of that side."""
    cell = np.floor(points / cutoff).astype(np.int64)
    cell -= cell.min(axis=0) - 1
    size = cell.max(axis=0) + 2
    place = (cell[:, 0] * size[1] + cell[:, 1]) * size[2] + cell[:, 2]
    order = np.argsort(place, kind="stable")
    ranked = place[order]
    found = []
    for step in ((a * size[1] + b) * size[2] + c for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)):
        low, high = (np.searchsorted(ranked, place + step, side) for side in ("left", "right"))
        n = high - low
        i = np.repeat(np.arange(len(points)), n)
        j = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
        r2 = ((points[i] - points[j]) ** 2).sum(axis=1)
        take = (i < j) & (r2 <= cutoff**2) & (r2 > 1e-12)
        found.append((i[take], j[take]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def levels(n: int, i: np.ndarray, j: np.ndarray) -> list[np.ndarray]:
    """The nodes by distance from an outlying one, one part of the graph after another; neighbours are in neighbouring levels."""
    both, other = np.concatenate((i, j)), np.concatenate((j, i))
    order = np.argsort(both, kind="stable")
    other = other[order]
    first = np.searchsorted(both[order], np.arange(n + 1))

    def walk(start: int) -> list[np.ndarray]:
        seen, out = {start}, [np.array([start])]
        while len(out[-1]):
            new = np.unique(np.concatenate([other[first[v] : first[v + 1]] for v in out[-1]]))
            new = np.array([v for v in new.tolist() if v not in seen], dtype=np.int64)
            seen.update(new.tolist())
            out.append(new)
        return out[:-1]

    left, found = np.ones(n, dtype=bool), []
    while left.any():
        part = walk(int(np.flatnonzero(left)[0]))
        for _ in range(2):  # from the far end, levels are more and narrower
            again = walk(int(part[-1][0]))
            part = again if len(again) >= len(part) else part
        for level in part:
            left[level] = False
        found += part
    return found


class Stiffness:
    """A network's stiffness: its product with vectors, and solutions of (stiffness + shift) x = b."""

    def __init__(self, points: np.ndarray, cutoff: float, power: float = 0.0, extra: list[tuple[int, int]] = ()):
        self.n = len(points)
        self.i, self.j = near_pairs(points, cutoff)
        far = [(min(p), max(p)) for p in extra if cutoff < np.linalg.norm(points[p[0]] - points[p[1]])]
        if far:  # springs at any distance, once each
            more = np.unique(np.array(far, dtype=np.int64), axis=0)
            self.i, self.j = np.concatenate((self.i, more[:, 0])), np.concatenate((self.j, more[:, 1]))
        gap = points[self.j] - points[self.i]
        r = np.sqrt((gap**2).sum(axis=1))
        self.pull = gap / r[:, None] * np.sqrt((cutoff / r) ** power)[:, None]  # the spring's matrix is its own square
        diagonal = np.bincount(np.concatenate((self.i, self.j)), np.tile((self.pull**2).sum(axis=1), 2), self.n)
        self.shift = _SHIFT * max(float(diagonal.mean()) / 3, 1e-12)
        self.levels = levels(self.n, self.i, self.j)
        self._factor()

    def times(self, x: np.ndarray) -> np.ndarray:
        x = x.reshape(self.n, 3, -1)
        force = self.pull[:, :, None] * np.einsum("ek,ekm->em", self.pull, x[self.i] - x[self.j])[:, None, :]
        out = np.zeros_like(x)
        np.add.at(out, self.i, force)
        np.subtract.at(out, self.j, force)
        return out.reshape(3 * self.n, -1)

    def _factor(self) -> None:
        """Cholesky factors level by level: what each level leaves of the next, and the inverse of its own triangle."""
        level, place = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        for k, nodes in enumerate(self.levels):
            level[nodes], place[nodes] = k, np.arange(len(nodes))
        blocks = self.pull[:, :, None] * self.pull[:, None, :]
        axis = np.arange(3)
        cell = lambda row, column: (row[:, None, None], axis[:, None], column[:, None, None], axis)
        own, down = [], []
        for k, nodes in enumerate(self.levels):
            one = np.zeros((len(nodes), 3, len(nodes), 3))
            one[np.arange(len(nodes)), :, np.arange(len(nodes)), :] += self.shift * np.eye(3)
            for v in (self.i, self.j):
                e = np.flatnonzero(level[v] == k)
                np.add.at(one, cell(place[v[e]], place[v[e]]), blocks[e])
            e = np.flatnonzero((level[self.i] == k) & (level[self.j] == k))
            for a, b in ((self.i, self.j), (self.j, self.i)):
                np.subtract.at(one, cell(place[a[e]], place[b[e]]), blocks[e])
            own.append(one)
            after = np.zeros((len(self.levels[k + 1]), 3, len(nodes), 3)) if k + 1 < len(self.levels) else None
            for low, high in ((self.i, self.j), (self.j, self.i)):
                e = np.flatnonzero((level[low] == k) & (level[high] == k + 1))
                if len(e):
                    np.subtract.at(after, cell(place[high[e]], place[low[e]]), blocks[e])
            down.append(after)
        self.inverse, self.carry, late = [], [], None
        for k, nodes in enumerate(self.levels):
            matrix = own[k].reshape(3 * len(nodes), -1)
            if late is not None:
                matrix = matrix - late @ late.T
            inverse = np.linalg.inv(np.linalg.cholesky(matrix))
            late = None if down[k] is None else down[k].reshape(-1, 3 * len(nodes)) @ inverse.T
            self.inverse.append(inverse)
            self.carry.append(late)

    def solve(self, b: np.ndarray) -> np.ndarray:
        b = b.reshape(self.n, 3, -1)
        parts = [b[nodes].reshape(3 * len(nodes), -1) for nodes in self.levels]
        for k, inverse in enumerate(self.inverse):
            parts[k] = inverse @ (parts[k] - self.carry[k - 1] @ parts[k - 1] if k else parts[k])
        for k in range(len(parts) - 1, -1, -1):
            late = parts[k] if self.carry[k] is None else parts[k] - self.carry[k].T @ parts[k + 1]
            parts[k] = self.inverse[k].T @ late
        out = np.empty_like(b)
        for nodes, part in zip(self.levels, parts, strict=True):
            out[nodes] = part.reshape(len(nodes), 3, -1)
        return out.reshape(3 * self.n, -1)


def slowest(stiffness: Stiffness, k: int, *, width: int = 12, most_steps: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, vectors, residuals) of the k slowest non-trivial modes; an error if a residual stays too large.

    Blocks of ``width`` vectors, from a fixed first block, so that modes of one eigenvalue (the six rigid ones among
    them) are all found. Every block is made orthogonal to all before it.
    """
    size = 3 * stiffness.n
    start = np.sin(np.outer(np.arange(1, size + 1), np.arange(1, min(width, size) + 1)))
    block = np.linalg.qr(start)[0]
    basis, images = block, stiffness.times(block)
    for _ in range(most_steps):
        small = basis.T @ images
        values, turn = np.linalg.eigh((small + small.T) / 2)
        at = np.flatnonzero(values > ZERO_MODE)[:k]
        vectors = basis @ turn[:, at]
        residuals = np.linalg.norm(images @ turn[:, at] - vectors * values[at], axis=0) / np.maximum(1.0, np.abs(values[at]))
        whole = basis.shape[1] >= size
        settled = len(at) == k and basis.shape[1] >= min(size, 2 * (at[-1] + 1)) if len(at) else False
        if whole or (settled and residuals.max() <= MOST_RESIDUAL):
            break
        block = stiffness.solve(block)
        for _ in range(2):
            block = block - basis @ (basis.T @ block)
        block, triangle = np.linalg.qr(block)
        strong = np.abs(np.diag(triangle)) > 1e-13 * max(np.abs(triangle).max(), 1e-300)
        block = block[:, strong][:, : size - basis.shape[1]]
        block = block - basis @ (basis.T @ block)
        block = np.linalg.qr(block)[0]
        if not block.shape[1]:
            break
        basis, images = np.hstack((basis, block)), np.hstack((images, stiffness.times(block)))
    if residuals.max(initial=0.0) > MOST_RESIDUAL:
        raise ValueError(f"slow modes did not settle: residual {residuals.max():.3g}")
    return values[at], vectors, residuals


def sparse_network_modes(atoms: DataFrame, key: str, order: str, cutoff: float, k: int, *, power: float = 0.0) -> DataFrame:
    """(key, mode from 1, eigenvalue, residual, vector) of the k slowest non-trivial modes of each structure.

    As ``network_modes``, for structures whose dense matrix would not fit a task: the springs and the levels' factors
    are all that is held. A structure of fewer modes gives those it has; a residual beyond ``MOST_RESIDUAL`` is an
    error. The largest component of a vector is positive.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        points = pdf.sort_values(order)[["x", "y", "z"]].to_numpy(float)
        values, vectors, residuals = slowest(Stiffness(points, cutoff, power), k)
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(values), "mode": np.arange(1, len(values) + 1), "eigenvalue": values, "residual": residuals, "vector": list(vectors.T)})

    schema = T.StructType([T.StructField(key, atoms.schema[key].dataType), *T.StructType.fromDDL("mode int, eigenvalue double, residual double, vector array<double>").fields])
    return atoms.groupBy(key).applyInPandas(solve, schema)
