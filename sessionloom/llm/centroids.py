"""Exact integer k-means with screening by norms of segments."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import cut

#: Components of a segment whose residuals one norm stands for.
SEGMENT = 8
#: Bits of a component in a compressed vector.
CODE_BITS = 4
#: Components below this have squared distances that no 64-bit sum overflows; larger ones are reckoned in Python's integers.
WIDE = 1 << 26
#: Bits of the limbs in which sums of components go through Spark, and limbs of a sum.
LIMB, LIMBS = 40, 5
#: Vectors handled at once.
STEP_ROWS = 4096


def quantised(column: pa.Array, dim: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have dim finite components, and those as integers floor(scale x): 64-bit, or Python's where one is WIDE."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(sizes == dim)
    if not len(at):
        return at, np.zeros((0, dim), np.int64)
    flat = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    good = np.isfinite(flat).all(1)
    at, flat = at[good], np.floor(scale * flat[good])
    if len(flat) and np.abs(flat).max() >= WIDE:
        return at, np.array([[int(x) for x in row] for row in flat.tolist()], object)
    return at, flat.astype(np.int64)


class Screened:
    """Centroids made ready for assignment; counts the exact distances that it reckons."""

    def __init__(self, centroids: list[list[int]]):
        wide = any(abs(x) >= WIDE for c in centroids for x in c)
        self.exact = np.array(centroids, object if wide else np.int64)
        self.pairs = self.compared = 0
        if not wide:
            # distances stay the same when both sides are moved, and short centroids have tight bounds
            self.origin = np.rint(self.exact.mean(0)).astype(np.int64)
            moved = (self.exact - self.origin).astype(np.float64)
            self.moved, self.square, self.norms = moved, (moved * moved).sum(1), self._norms(moved)

    @staticmethod
    def _norms(x: np.ndarray) -> np.ndarray:
        pad = -x.shape[1] % SEGMENT
        return np.sqrt((np.pad(x, ((0, 0), (0, pad))).reshape(len(x), -1, SEGMENT) ** 2).sum(2))

    def bounds(self, vectors: np.ndarray) -> np.ndarray:
        """Lower bounds of all squared distances.

        A vector is its compressed form (components cut to CODE_BITS bits, by a step of its own) plus a residual. Its inner product with a centroid is that of the
        compressed form and, by Cauchy-Schwarz, no more than the sum over segments of the residual's norm times the centroid's.
        """
        moved = vectors - self.origin
        most = np.abs(moved).max(1, initial=1)
        shift = np.maximum(np.ceil(np.log2(most + 1)).astype(np.int64) - (CODE_BITS - 1), 0)
        code = moved >> shift[:, None]
        middle = (code << shift[:, None]) + ((1 << shift) >> 1)[:, None]
        residual = self._norms((moved - middle).astype(np.float64))
        square = (moved.astype(np.float64) ** 2).sum(1)
        low = square[:, None] + self.square - 2 * (middle.astype(np.float64) @ self.moved.T + residual @ self.norms.T)
        # room for rounding
        return low - 1e-9 * (square[:, None] + self.square) - 0.5

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's nearest centroid (ties: the smaller number) and its squared distance."""
        k = len(self.exact)
        self.pairs += len(vectors) * k
        if vectors.dtype == object or self.exact.dtype == object:
            own = vectors.astype(object)
            far = np.array([[sum(d * d for d in row) for row in (own - c).tolist()] for c in self.exact.astype(object)], object).reshape(k, -1)
            self.compared += far.size
            best = np.array([min(range(k), key=lambda c: far[c, i]) for i in range(len(own))], np.int64)
            return best, far[best, np.arange(len(own))]
        low = self.bounds(vectors)
        rows = np.arange(len(vectors))
        best = low.argmin(1)
        distance = ((vectors - self.exact[best]) ** 2).sum(1)
        low[rows, best] = np.inf
        self.compared += len(vectors)
        at, other = np.nonzero(low <= distance[:, None])
        self.compared += len(at)
        exact = ((vectors[at] - self.exact[other]) ** 2).sum(1)
        order = np.lexsort((other, exact, at))
        at, other, exact = at[order], other[order], exact[order]
        head = np.r_[True, at[1:] != at[:-1]][: len(at)]
        at, other, exact = at[head], other[head], exact[head]
        better = (exact < distance[at]) | ((exact == distance[at]) & (other < best[at]))
        best[at[better]], distance[at[better]] = other[better], exact[better]
        return best, distance


def _slices(batches: Iterator[pa.RecordBatch], dim: int, scale: float) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for i in range(0, batch.num_rows, STEP_ROWS):
            part = batch.slice(i, STEP_ROWS)
            at, vectors = quantised(part.column("vector"), dim, scale)
            yield part, at, vectors


def _sums(shipped, dim: int, scale: float):
    """A task's sums of components and numbers of vectors by centroid, in limbs."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screened: Screened = shipped.value
        k = len(screened.exact)
        total, members = np.zeros((k, dim), object), np.zeros(k, np.int64)
        for _, _, vectors in _slices(batches, dim, scale):
            best, _ = screened.assign(vectors)
            members += np.bincount(best, minlength=k)
            for c in np.unique(best).tolist():
                total[c] += vectors[best == c].sum(0)
        cells = np.arange(k * dim)
        out = [(np.full(k, -1), np.arange(k), members)]
        left = [int(x) for x in total.reshape(-1)]
        for limb in range(LIMBS):
            last = limb == LIMBS - 1
            out.append((np.full(k * dim, limb), cells, np.array([x if last else x & ((1 << LIMB) - 1) for x in left], np.int64)))
            left = [x >> LIMB for x in left]
        limb, cell, value = (np.concatenate(x) for x in zip(*out))
        yield pa.RecordBatch.from_arrays([pa.array(limb.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(value.astype(np.int64))], names=["limb", "cell", "value"])

    return sums


def _moved(rows: DataFrame, centroids: list[list[int]], dim: int, scale: float) -> list[list[int]]:
    """The centroids after one round; LIMBS numbers a component come to the driver, however many rows there are."""
    shipped = rows.sparkSession.sparkContext.broadcast(Screened(centroids))
    found = rows.mapInArrow(_sums(shipped, dim, scale), "limb int, cell int, value long").groupBy("limb", "cell").agg(F.sum("value").alias("value")).collect()
    members = {r["cell"]: r["value"] for r in found if r["limb"] < 0}
    total: dict[int, int] = {}
    for r in found:
        if r["limb"] >= 0:
            total[r["cell"]] = total.get(r["cell"], 0) + (r["value"] << (LIMB * r["limb"]))
    return [[total[c * dim + i] // members[c] for i in range(dim)] if members.get(c) else list(old) for c, old in enumerate(centroids)]


def _assigned(shipped, dim: int, scale: float):
    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screened: Screened = shipped.value
        for part, at, vectors in _slices(batches, dim, scale):
            best, distance = screened.assign(vectors)
            fits = [int(d) if d < 1 << 63 else None for d in distance] if distance.dtype == object else distance
            yield pa.RecordBatch.from_arrays([part.column("vec_id").take(pa.array(at)), pa.array(best.astype(np.int32)), pa.array(fits, pa.int64())], names=["vec_id", "cluster", "distance"])

    return assigned


def centroid_clusters(embeddings: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: float = 64.0, seed: int = 1, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """K-means of integer vectors: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly ``dim`` finite components, as integers floor(scale x). The k vectors with the least sha256 of ``seed:vec_id`` start
    as centroids; each round assigns every vector to its nearest centroid (squared distance, ties to the smaller number) and moves non-empty centroids to the floor of their mean; a last assignment follows.
    Every centroid gets a lower bound from the compressed vector and norms of segments, and only those that the best exact distance does not exclude get an exact integer distance, so
    the result is that of the plain method. Tasks send sums by centroid, never vectors; k centroids are broadcast.

    Null, short, long or non-finite vectors take no part; rows with equal vec_id are vectors each, and of equal digests that with the lesser components comes first; rows without vec_id are assigned, and start only where others are too few.
    Fewer than k kept vectors make fewer centroids; an empty table gives no rows. Components of 2^26 and more are reckoned in Python's integers; a distance that no long holds is null,
    and so are the sums over it. Other columns are left out. Not lazy: the rounds run at once.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector"))
    finite = (F.size("vector") == dim) & F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    heads = rows.where(finite).orderBy(digest.asc_nulls_last(), "vector").limit(k).select("vector").toArrow()
    if not heads.num_rows:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    _, first = quantised(heads.column("vector").combine_chunks(), dim, scale)
    centroids = [[int(x) for x in c] for c in first]
    for _ in range(rounds):
        centroids = _moved(rows, centroids, dim, scale)
    kind = embeddings.schema[vec_id].dataType.simpleString()
    shipped = spark.sparkContext.broadcast(Screened(centroids))
    assigned = cut(rows.mapInArrow(_assigned(shipped, dim, scale), f"vec_id {kind}, cluster int, distance long"))
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    by_cluster = {r["cluster"]: (int(r["s"] or 0), r["whole"]) for r in assigned.groupBy("cluster").agg(total.alias("s"), (F.count("distance") == F.count("*")).alias("whole")).collect()}
    every = sum(s for s, _ in by_cluster.values()) if all(whole for _, whole in by_cluster.values()) else None
    fits = lambda s: s if s is not None and s < 1 << 63 else None
    sums = spark.createDataFrame(
        [(c, fits(s if whole else None), fits(every), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, (s, whole) in by_cluster.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    # at most k rows
    return assigned.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
