"""Label propagation among many rows: each round gathers kernel sums by features (``kernel``) and moves all rows by them, so that work grows with the rows."""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.operators import kernel

CLASS_COUNT = 3
_P, _A = [f"p{i}" for i in range(CLASS_COUNT)], [f"a{i}" for i in range(CLASS_COUNT)]
_STATE = "spot long, x array<double>, open double, " + ", ".join(f"{c} double" for c in (*_A, *_P, "total", "gap"))
_NAMES = [c.split()[0] for c in _STATE.split(", ")]
#: Rows of a partition, about.
PART_ROWS = 1 << 14


class Singles:
    """Spots that take no part in the features' sums, or whose sum is too small for their error: each is summed over all rows. The driver holds them, MOST_SINGLE at most."""

    def __init__(self, rows: list, width: int):
        rows = sorted(rows, key=lambda r: r["spot"])
        table = lambda names: np.array([[r[c] for c in names] for r in rows], np.float64).reshape(len(rows), len(names))
        self.spot, self.x = np.array([r["spot"] for r in rows], np.int64), np.array([r["x"] for r in rows], np.float64).reshape(-1, width)
        self.open, self.a, self.p = table(["open"])[:, 0], table(_A), table(_P)

    def places(self, spots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of some spots are here, and where."""
        at = np.minimum(np.searchsorted(self.spot, spots), max(len(self.spot) - 1, 0))
        own = np.flatnonzero(self.spot[at] == spots) if len(self.spot) else np.zeros(0, int)
        return own, at[own]

    def move(self, sums: np.ndarray) -> None:
        """By their sums over all other spots; their own spot's other rows come to these."""
        sums = sums + _others(self.open, self.a, self.p)
        total = sums[:, 0]
        mean = np.where(total[:, None] > 0, sums[:, 1:] / np.where(total > 0, total, 1)[:, None], 0.0)
        self.p = np.where(self.open[:, None] > 0, mean, self.p)


def _weights(open_: np.ndarray, a: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Of each spot its rows, and what they have of each class."""
    return np.column_stack([open_ + a.sum(1), open_[:, None] * p + a])


def _others(open_: np.ndarray, a: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The same without one open row."""
    return _weights(open_, a, p) - np.column_stack([np.ones(len(p)), p])


def _read(batch, width: int) -> tuple[np.ndarray, ...]:
    """Spot, x, open, a, p and gap of a batch."""
    plain = lambda names: np.column_stack([batch.column(_NAMES.index(c)).to_numpy(zero_copy_only=False) for c in names])
    return batch.column(0).to_numpy(zero_copy_only=False), kernel.matrix(batch.column(1), width), plain(["open"])[:, 0], plain(_A), plain(_P), plain(["gap"])[:, 0]


def _gather(now: DataFrame, features: kernel.Features, singles: Singles, sigma: float, tolerance: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums by features, sums of the singles over all other spots, and how many open spots have moved by the tolerance or more."""
    width, shape = singles.x.shape[1], (features.cells, CLASS_COUNT + 1, features.rows)
    shipped = now.sparkSession.sparkContext.broadcast((features, singles))

    def add(batches):
        features, singles = shipped.value
        sums, each, moved = np.zeros(shape), np.zeros((len(singles.spot), CLASS_COUNT + 1)), 0
        for batch in batches:
            spot, x, open_, a, p, gap = _read(batch, width)
            fine, w = np.isfinite(x).all(1), _weights(open_, a, p)
            close = kernel.near(x)
            features.add(sums, x[close], w[close])
            moved += int((gap[open_ > 0] >= tolerance).sum())
            step = max(1, kernel.CELLS // max(len(each), 1))
            for at in range(0, len(x) if len(each) else 0, step):
                some = np.flatnonzero(fine[at : at + step]) + at
                k = kernel.gauss(singles.x, x[some], sigma)
                own, where = singles.places(spot[some])
                k[where, own] = 0
                each += k @ w[some]
        yield from kernel.pieces(np.concatenate([sums.reshape(-1), each.reshape(-1), [float(moved)]]))

    n, m = int(np.prod(shape)), len(singles.spot) * (CLASS_COUNT + 1)
    got = kernel.summed(now.mapInArrow(add, kernel.PIECES), n + m + 1)
    shipped.unpersist()
    return got[:n].reshape(shape), got[n : n + m].reshape(-1, CLASS_COUNT + 1), int(got[-1])


def _moved(now: DataFrame, features: kernel.Features, sums: np.ndarray, far: tuple[np.ndarray, np.ndarray], singles: Singles, sigma: float) -> DataFrame:
    """All spots after a round: open ones by the sums (those near) or as ``singles`` have them; ``far`` are vectors and weights that the sums lack."""
    width = singles.x.shape[1]
    shipped = now.sparkSession.sparkContext.broadcast((features, sums, far, singles))

    def move(batches):
        features, sums, (far_x, far_w), singles = shipped.value
        for batch in batches:
            spot, x, open_, a, p, _ = _read(batch, width)
            new, total = p.copy(), np.full(len(x), np.nan)
            own, where = singles.places(spot)
            asked = kernel.near(x) & (open_ > 0)
            asked[own] = False
            got = features.at(sums, x[asked])
            step = max(1, kernel.CELLS // max(len(far_x), 1))
            for at in range(0, len(got) if len(far_x) else 0, step):
                got[at : at + step] += kernel.gauss(x[asked][at : at + step], far_x, sigma) @ far_w
            # less the row itself, which is as near to itself as can be
            got -= np.column_stack([np.ones(len(got)), p[asked]])
            total[asked] = got[:, 0]
            new[asked] = got[:, 1:] / np.where(got[:, 0] > 0, got[:, 0], 1)[:, None]
            new[own] = singles.p[where]
            new[~np.isfinite(x).all(1)] = 0
            gap = np.abs(new - p).max(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *batch.columns[3 : 3 + CLASS_COUNT], *(pa.array(c) for c in new.T.copy()), pa.array(total), pa.array(gap)], names=_NAMES)

    return now.mapInArrow(move, _STATE)


def spread(points: DataFrame, features: kernel.Features, anchor: str, sigma: float, rounds: int | None, tolerance: float) -> DataFrame | None:
    """(x, p0, p1, p2) of the open rows at each different x after so many rounds, or after the first that moves none by the tolerance; None if too many spots would have to be summed one by one.

    ``points`` has x, the anchor and m, how many rows are there. What a task and the driver hold is bounded by the features and MOST_SINGLE. A sum's error is below ``kernel.ERROR`` of it.
    """
    spark, width = points.sparkSession, len(features.components)
    of = lambda c, given: F.coalesce(F.sum(F.when(given, F.col("m"))), F.lit(0)).cast("double").alias(c)
    spots = points.groupBy("x").agg(of("open", F.col(anchor).isNull()), *[of(c, F.col(anchor) == i) for i, c in enumerate(_A)])
    order = [F.get("x", F.lit(i)) for i in features.order]
    n, rows = points.agg(F.count("*"), F.sum("m")).first()
    parts = max(1, min(4 * spark.sparkContext.defaultParallelism, n // PART_ROWS))
    spots = spots.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    start = [F.lit(1 / CLASS_COUNT).alias(c) for c in _P]
    now = spots.select(F.monotonically_increasing_id().alias("spot"), "x", "open", *_A, *start, F.lit(None).cast("double").alias("total"), F.lit(np.inf).alias("gap")).checkpoint()
    away = F.array_max(F.transform("x", F.abs))
    outside = now.where(away > kernel.FAR).where(~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == np.inf))).limit(kernel.MOST_SINGLE + 1).collect()
    if len(outside) > kernel.MOST_SINGLE:
        return None
    far = Singles(outside, width)
    weights = lambda s, of_these: (s.x[of_these], _weights(s.open, s.a, s.p)[of_these])
    # which sums are too small for the features' error
    sums, _, _ = _gather(now, features, far, sigma, tolerance)
    least = features.error * rows / kernel.ERROR
    weak = _moved(now, features, sums, weights(far, np.full(len(far.spot), True)), far, sigma).where(F.col("total") < least).select("spot", "x", "open", *_A).limit(kernel.MOST_SINGLE + 1)
    weak = weak.select("*", *start).collect()
    if len(outside) + len(weak) > kernel.MOST_SINGLE:
        return None
    singles = Singles(outside + weak, width)
    is_far = ~kernel.near(singles.x)
    for r in count() if rounds is None else range(rounds):
        sums, each, moved = _gather(now, features, singles, sigma, tolerance)
        if r and not moved:
            break
        beyond = weights(singles, is_far)
        singles.move(each)
        now = _moved(now, features, sums, beyond, singles, sigma).checkpoint()
    return now.where("open > 0").select("x", *_P)
