"""Sums of a Gaussian kernel over many rows, by features whose inner product is the kernel: work grows with the rows, not with their square."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Different values up to which a component has a feature for each (the kernel between them is then exact); of more, it has Chebyshev polynomials.
VALUES = 64
#: Components beyond this are far; their rows are gone through one by one, and so are rows whose sum is too small for the kernel's error. More of them than MOST_SINGLE are not taken on.
FAR, MOST_SINGLE = 8.0, 1 << 16
#: Most features of the product of all components (with four sums each, 64 MB), and of the components that are expanded row by row.
MOST_FEATURES, MOST_BY_ROW = 1 << 21, 1 << 10
#: What a sum's error may be, as a share of the sum.
ERROR = 1e-9
#: Eigenvalues that are left out, as a share of the largest; numbers of an array that a task has at a time; numbers in a piece of a sum.
EIGEN, CELLS, PIECE = 1e-14, 1 << 21, 1 << 12


class Component:
    """Features of one component x, whose inner products are exp(-(x - y)^2 / (2 sigma^2)) with an error of at most ``error``."""

    def __init__(self, values: list[float] | None, low: float, high: float, sigma: float):
        gauss = lambda x: np.exp(-((x[:, None] - x) ** 2) / (2 * sigma * sigma))
        self.values, self.low, self.high = None if values is None else np.array(sorted(values)), low, high
        if values is not None:
            kernel = gauss(self.values)
        else:
            r = int(16 + 6 * (high - low) / sigma)
            k = np.arange(r)
            angles = (2 * k + 1) * np.pi / (2 * r)
            # from values at the nodes to coefficients
            to = np.cos(k[:, None] * angles) * 2 / r
            to[0] /= 2
            kernel = to @ gauss((low + high) / 2 + (high - low) / 2 * np.cos(angles)) @ to.T
        size, vectors = np.linalg.eigh((kernel + kernel.T) / 2)
        kept = size > EIGEN * size.max()
        self.map = vectors[:, kept] * np.sqrt(size[kept])
        at = self.values if values is not None else np.linspace(low, high, 1_000)
        f = self(at)
        # measured between the nodes, and twice that for what lies between the measures
        self.error = 2 * float(np.abs(f @ f.T - gauss(at)).max())

    @property
    def n(self) -> int:
        return self.map.shape[1]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.values is not None:
            return self.map[np.searchsorted(self.values, x)]
        t = np.clip((2 * x - self.low - self.high) / (self.high - self.low), -1, 1)
        return np.cos(np.arange(len(self.map)) * np.arccos(t)[:, None]) @ self.map


def _product(parts: list[np.ndarray], n: int) -> np.ndarray:
    """Row by row, all products of a feature of each part."""
    out = np.ones((n, 1))
    for f in parts:
        out = (out[:, :, None] * f[:, None, :]).reshape(n, -1)
    return out


class Features:
    """Products of the components' features. Components of many values are expanded row by row; the others by their different combinations, of which neighbouring rows share most."""

    def __init__(self, components: list[Component]):
        self.components = components
        self.by_row, self.by_cell, n = [], [], 1
        for i in sorted(range(len(components)), key=lambda i: (components[i].values is not None, -components[i].n)):
            if n * components[i].n <= MOST_BY_ROW and (components[i].values is None or not self.by_row):
                self.by_row.append(i)
                n *= components[i].n
            else:
                self.by_cell.append(i)
        self.rows = n
        self.cells = int(np.prod([float(components[i].n) for i in self.by_cell])) if self.by_cell else 1
        self.error = float(np.prod([1 + c.error for c in components]) - 1)

    @property
    def order(self) -> list[int]:
        """Components in the order by which rows are best sorted."""
        return self.by_cell + self.by_row

    def _slices(self, x: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """Some rows at a time: which, their features by row, the features of their cells, and where each row's cell is."""
        step = max(1, min(CELLS // (4 * self.rows), CELLS // self.cells))
        for at in range(0, len(x), step):
            part = slice(at, min(at + step, len(x)))
            some = x[part]
            cells, place = np.unique(some[:, self.by_cell], axis=0, return_inverse=True) if self.by_cell else (np.zeros((1, 0)), np.zeros(len(some), int))
            yield part, _product([self.components[i](some[:, i]) for i in self.by_row], len(some)), _product([self.components[i](cells[:, j]) for j, i in enumerate(self.by_cell)], len(cells)), place.reshape(-1)

    def add(self, sums: np.ndarray, x: np.ndarray, weights: np.ndarray) -> None:
        """Add rows with their weights (rows x w) to ``sums`` (cells x w x rows)."""
        for part, f, cells, place in self._slices(x):
            order = np.argsort(place, kind="stable")
            starts = np.searchsorted(place[order], np.arange(len(cells)))
            w = weights[part]
            by = np.stack([np.add.reduceat(f[order] * w[order, c][:, None], starts) for c in range(w.shape[1])], axis=1)
            sums += (cells.T @ by.reshape(len(cells), -1)).reshape(sums.shape)

    def at(self, sums: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Kernel sums (rows x w) at rows, from what ``add`` has gathered."""
        out = np.empty((len(x), sums.shape[1]))
        for part, f, cells, place in self._slices(x):
            by = (cells @ sums.reshape(len(sums), -1)).reshape(len(cells), sums.shape[1], -1)
            out[part] = np.einsum("nr,nwr->nw", f, by[place])
        return out


def gauss(x: np.ndarray, y: np.ndarray, sigma: float) -> np.ndarray:
    """The kernel of all rows of x by all of y, from differences, so that near rows lose no digits."""
    out = np.zeros((len(x), len(y)))
    for i in range(x.shape[1]):
        d = x[:, i, None] - y[:, i]
        d *= d
        out += d
    out /= -2 * sigma * sigma
    return np.exp(out, out=out)


def features_of(rows: DataFrame, vector: str, width: int, sigma: float) -> Features | None:
    """Features for the rows' vectors; None where their product would be too large. Non-finite vectors are left out."""

    def said(batches):
        seen: list[set | None] = [set() for _ in range(width)]
        low, high = np.full(width, np.inf), np.full(width, -np.inf)
        for batch in batches:
            x = matrix(batch.column(0), width)
            x = x[near(x)]
            for i in range(width if len(x) else 0):
                low[i], high[i] = min(low[i], x[:, i].min()), max(high[i], x[:, i].max())
                if seen[i] is not None:
                    seen[i].update(np.unique(x[:, i]).tolist())
                    seen[i] = seen[i] if len(seen[i]) <= VALUES else None
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(width), pa.int32()), pa.array(low), pa.array(high), pa.array([None if s is None else sorted(s) for s in seen], pa.list_(pa.float64()))], names=["i", "low", "high", "seen"]
        )

    told = rows.select(vector).mapInArrow(said, "i int, low double, high double, seen array<double>").groupBy("i")
    told = told.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.bool_and(F.col("seen").isNotNull()).alias("few"), F.flatten(F.collect_set("seen")).alias("seen")).collect()
    components = [None] * width
    for r in told:
        values = set(r["seen"]) if r["few"] else None
        values = values if values is not None and len(values) <= VALUES else None
        if not np.isfinite(r["low"]):
            return None
        components[r["i"]] = Component(sorted(values) if values is not None else None, r["low"], r["high"], sigma)
    if None in components or np.prod([float(c.n) for c in components]) > MOST_FEATURES:
        return None
    return Features(components)


def matrix(column, width: int) -> np.ndarray:
    """An Arrow column of lists as a matrix; a row of nulls for a list that is null or has one."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not column.null_count and not column.values.null_count:
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    return np.array([x if x is not None and None not in x else [np.nan] * width for x in column.to_pylist()], np.float64).reshape(-1, width)


def near(x: np.ndarray) -> np.ndarray:
    """Which rows are finite and not far."""
    return (np.abs(x) <= FAR).all(1)


def summed(parts: DataFrame, length: int) -> np.ndarray:
    """One vector, of bounded length, from the vectors that tasks yield in pieces (``pieces``): summed by piece in tasks, then put together."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = np.frombuffer(values)
                sums[at] = sums[at] + got if at in sums else got
        for at, got in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([got.tobytes()], pa.binary())], names=["at", "numbers"])

    out = np.zeros(length)
    for r in parts.repartition(max(1, min(16, length // (8 * PIECE))), "at").mapInArrow(add, "at int, numbers binary").collect():
        got = np.frombuffer(r["numbers"])
        out[r["at"] * PIECE : r["at"] * PIECE + len(got)] = got
    return out


def pieces(vector: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(vector), PIECE):
        yield pa.RecordBatch.from_arrays([pa.array([at // PIECE], pa.int32()), pa.array([np.ascontiguousarray(vector[at : at + PIECE]).tobytes()], pa.binary())], names=["at", "numbers"])


PIECES = "at int, numbers binary"
