"""Nearest neighbours by inner product over randomly rotated one-bit codes with error bounds.

The first code has the signs of a vector's rotated components; each further one has the signs of what the codes before leave. Estimates from more codes have narrower bounds, and a pair is
looked at by a further code only where the bound of those before lets it through; what passes all of them is reranked on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionloom.llm.common import cut

#: Queries that one pass over the codes answers; they are broadcast, at 8 bytes a dimension.
QUERY_BLOCK = 16_384
#: One-bit codes of a vector.
CODES = 6
#: Bits to which a rotated query's components are rounded.
QUERY_BITS = 8
#: Width of the error bound in standard deviations of the estimate.
EPSILON = 4.0
#: Times k: the estimates from which a query's first floor is taken.
FLOOR_TRIES = 4
#: Pairs of query and code that one vectorised step handles.
STEP_PAIRS = 1 << 18
#: Pairs whose original vectors are compared at once: small enough for a core's cache.
EXACT_PAIRS = 4096
SEED = 20240527

INDEX = "vec_id long, vector binary, code binary, scalars binary, radius double"


def _vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have dim finite components, not all zero, and those vectors in double precision."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(sizes == dim)
    if not len(at):
        return at, np.zeros((0, dim))
    flat = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    good = np.isfinite(flat).all(1) & (flat != 0).any(1)
    return at[good], np.ascontiguousarray(flat[good])


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def exact_scores(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray) -> np.ndarray:
    """Inner products of rows a[at] and b[bt] in double precision, components added in order."""
    total = np.zeros(len(at))
    for i in range(0, len(at), EXACT_PAIRS):
        part = a[at[i : i + EXACT_PAIRS]] * b[bt[i : i + EXACT_PAIRS]]
        sums = total[i : i + EXACT_PAIRS]
        for column in np.ascontiguousarray(part.T):
            sums += column
    return total


def _dimension(df: DataFrame, vector: str) -> int:
    sizes = df.where(F.size(vector) > 0).groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return sizes["n"] if sizes else 0


def _centre(df: DataFrame, vector: str, dim: int) -> np.ndarray:
    """The mean of all vectors that take part, from one row of sums per partition, added up in Spark."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dim), 0
        for batch in batches:
            _, x = _vectors(batch.column(0), dim)
            total, n = total + x.sum(0), n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(total), pa.array(np.full(dim, float(n)))], names=["k", "total", "n"])

    added = df.select(vector).mapInArrow(sums, "k int, total double, n double").groupBy("k").agg(F.sum("total") / F.greatest(F.sum("n"), F.lit(1.0)))
    mean = np.zeros(dim)
    for k, x in added.collect():
        mean[k] = x
    return mean


def encode_vectors(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows, CODES, words of 64 bits) of rotated unit vectors, and scalars (rows, 3, CODES): the weight of each code, and for the first j codes what
    their sum is multiplied by for an unbiased estimate, and the standard deviation of that for a query of length 1.

    With c the weighted sum of codes and r what it leaves of the vector u, the inner product with a query is <q, c> + <q, r>. The part of r along u has the share <u, r> of the wanted product; the rest meets the query
    at random, as the rotation is random.
    """
    n, dim = unit.shape
    left, codes, scalars = unit.copy(), [], np.zeros((n, 3, CODES))
    for j in range(CODES):
        signs = left > 0
        weight = np.abs(left).mean(1)
        left -= weight[:, None] * np.where(signs, 1.0, -1.0)
        packed = np.packbits(signs, axis=1)
        codes.append(np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))).view(np.uint64))
        along = np.minimum((unit * left).sum(1), 0.999)
        gain = 1 / (1 - along)
        across = np.sqrt(np.maximum((left * left).sum(1) - along * along, 0))
        scalars[:, :, j] = np.stack([weight, gain, gain * across / np.sqrt(max(dim - 1, 1))], 1)
    return np.stack(codes, 1), scalars


def build_index(embeddings: DataFrame, vec_id: str, vector: str, dim: int, centre: np.ndarray) -> DataFrame:
    """One-bit codes of every vector that takes part: it is centred, scaled to length 1, rotated and encoded (see ``encode_vectors``); with the codes go their scalars and the distance to the centre."""
    turn = rotation(dim)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _vectors(batch.column("vector"), dim)
            ids = batch.column("vec_id").take(pa.array(at))
            off = x - centre
            radius = np.sqrt((off * off).sum(1))
            codes, scalars = encode_vectors(off / np.where(radius > 0, radius, 1)[:, None] @ turn)
            binary = [pa.array([v.tobytes() for v in part], pa.binary()) for part in (x, codes, scalars)]
            yield pa.RecordBatch.from_arrays([ids, *binary, pa.array(radius)], names=["vec_id", "vector", "code", "scalars", "radius"])

    rows = embeddings.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    return rows.mapInArrow(encode, INDEX)


class Codes:
    """The coded vectors of one Arrow batch."""

    def __init__(self, batch: pa.RecordBatch, dim: int):
        self.ids = batch.column("vec_id").to_numpy()
        n = len(self.ids)
        self.vectors = np.frombuffer(b"".join(batch.column("vector").to_pylist()), np.float64).reshape(-1, dim)
        self.codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint64).reshape(n, CODES, -(-dim // 64))
        self.ones = np.bitwise_count(self.codes).sum(2).astype(np.float64)
        self.weight, self.gain, self.spread = np.frombuffer(b"".join(batch.column("scalars").to_pylist()), np.float64).reshape(n, 3, CODES).transpose(1, 2, 0)
        self.radius = batch.column("radius").to_numpy()


class QueryBlock:
    """Queries made ready for estimates: rotated components in bit planes, with what turns sums of bits into inner products."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, centre: np.ndarray):
        self.ids, self.vectors, dim = ids, vectors, vectors.shape[1]
        turned = vectors @ rotation(dim)
        self.with_centre = vectors @ centre
        self.norm = np.sqrt((vectors * vectors).sum(1))
        low, high = turned.min(1), turned.max(1)
        self.low, self.step = low, np.where(high > low, (high - low) / ((1 << QUERY_BITS) - 1), 1)
        level = np.rint((turned - low[:, None]) / self.step[:, None]).astype(np.uint8)
        rounded = level * self.step[:, None] + low[:, None]
        self.sum = rounded.sum(1)
        # rounding moves the inner product with a vector of signs by no more than this
        self.slack = np.abs(rounded - turned).sum(1)
        planes = [np.packbits((level >> b) & 1, axis=1) for b in range(QUERY_BITS)]
        self.planes = [np.ascontiguousarray(np.pad(p, ((0, 0), (0, -p.shape[1] % 8)))).view(np.uint64) for p in planes]

    def first(self, rows: slice, of: Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For some queries and all vectors of a batch, by the first code: the sum so far, the estimate of the inner product, and the bound of its error."""
        bits = np.zeros((len(self.ids[rows]), len(of.ids)), np.int32)
        for b in reversed(range(QUERY_BITS)):
            bits <<= 1
            for w in range(of.codes.shape[2]):
                bits += np.bitwise_count(self.planes[b][rows, w, None] & of.codes[None, :, 0, w])
        signed = 2 * (bits * self.step[rows, None] + of.ones[:, 0] * self.low[rows, None]) - self.sum[rows, None]
        so_far = signed * of.weight[0]
        value = self.with_centre[rows, None] + so_far * (of.radius * of.gain[0])
        return so_far, value, self.slack[rows, None] * (of.radius * of.gain[0] * of.weight[0]) + self.norm[rows, None] * (EPSILON * of.radius * of.spread[0])

    def further(self, j: int, q: np.ndarray, v: np.ndarray, so_far: np.ndarray, of: Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for single pairs, with code j (from 0) added."""
        bits = np.zeros(len(q), np.int32)
        for b in reversed(range(QUERY_BITS)):
            bits <<= 1
            for w in range(of.codes.shape[2]):
                bits += np.bitwise_count(self.planes[b][q, w] & of.codes[v, j, w])
        signed = 2 * (bits * self.step[q] + of.ones[v, j] * self.low[q]) - self.sum[q]
        so_far = so_far + signed * of.weight[j, v]
        value = self.with_centre[q] + so_far * (of.radius[v] * of.gain[j, v])
        return so_far, value, self.slack[q] * (of.radius[v] * of.gain[j, v] * of.weight[: j + 1, v].sum(0)) + self.norm[q] * (EPSILON * of.radius[v] * of.spread[j, v])


def _best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best, ties to the smaller vec_id."""
    order = np.lexsort((vec, -score, query))
    q = query[order]
    first = np.r_[0, np.flatnonzero(np.diff(q)) + 1] if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return order[rank < k]


def _search(shipped, k: int, dim: int, counted: dict | None = None):
    """Answers a block of queries over the codes; ``counted`` gets the pairs that each code has let through, and those reranked."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: QueryBlock = shipped.value
        n = len(block.ids)
        count = counted if counted is not None else {}
        #: no more than the k-th best score so far of each query
        floor = np.full(n, -np.inf)
        kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for batch in batches:
            of = Codes(batch, dim)
            found = [kept]
            width = max(1, STEP_PAIRS // max(1, len(of.ids)))
            for at in range(0, n, width):
                rows = slice(at, min(n, at + width))
                so_far, value, error = block.first(rows, of)
                other = block.ids[rows, None] != of.ids[None, :]
                m = min(FLOOR_TRIES * k, len(of.ids) - 1)
                if m > k and not np.isfinite(floor[rows]).all():
                    # of the best estimates by all codes, the k-th lower bound is a floor
                    value[~other] = -np.inf
                    top = np.argpartition(value, len(of.ids) - m, axis=1)[:, len(of.ids) - m :]
                    tq, tv = np.repeat(np.arange(at, rows.stop), m), top.reshape(-1)
                    part = np.take_along_axis(so_far, top, 1).reshape(-1)
                    for j in range(1, CODES):
                        part, estimate, bound = block.further(j, tq, tv, part, of)
                    lower = np.where(np.isfinite(np.take_along_axis(value, top, 1)), (estimate - bound).reshape(-1, m), -np.inf)
                    floor[rows] = np.maximum(floor[rows], np.partition(lower, m - k, axis=1)[:, m - k])
                q, v = np.nonzero((value + error >= floor[rows, None]) & other)
                so_far, q = so_far[q, v], q + at
                count["pairs"] = count.get("pairs", 0) + value.size
                count[1] = count.get(1, 0) + len(q)
                for j in range(1, CODES):
                    so_far, value, error = block.further(j, q, v, so_far, of)
                    near = value + error >= floor[q]
                    q, v, so_far, value, error = q[near], v[near], so_far[near], value[near], error[near]
                    count[j + 1] = count.get(j + 1, 0) + len(q)
                # the k best estimates are reranked first, for a floor that leaves out most others
                best = _best(q, of.ids[v], value, k)
                score = np.full(len(q), np.nan)
                score[best] = exact_scores(block.vectors, q[best], of.vectors, v[best])
                full = np.bincount(q[best], minlength=n) >= k
                least = np.full(n, np.inf)
                np.minimum.at(least, q[best], score[best])
                floor = np.where(full, np.maximum(floor, least), floor)
                rest = np.flatnonzero(np.isnan(score) & (value + error >= floor[q]))
                score[rest] = exact_scores(block.vectors, q[rest], of.vectors, v[rest])
                ranked = np.flatnonzero(~np.isnan(score))
                count["reranked"] = count.get("reranked", 0) + len(ranked)
                q, v, score = q[ranked], v[ranked], score[ranked]
                best = _best(q, of.ids[v], score, k)
                found.append([q[best], of.ids[v][best], score[best]])
            kept = [np.concatenate(x) for x in zip(*found)]
            best = _best(*kept, k)
            kept = [x[best] for x in kept]
            full = np.flatnonzero(np.bincount(kept[0], minlength=n) >= k)
            if len(full):
                last = np.cumsum(np.bincount(kept[0], minlength=n)) - 1
                floor[full] = np.maximum(floor[full], kept[2][last[full]])
        yield pa.RecordBatch.from_arrays([pa.array(block.ids[kept[0]]), pa.array(kept[1]), pa.array(kept[2])], names=["query_id", "vec_id", "score"])

    return search


def nearest(embeddings: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", query_block: int = QUERY_BLOCK) -> DataFrame:
    """Each query's k vectors of the largest inner product, by one-bit codes and an exact rerank.

    Both tables have vec_id and an array of numbers; the vector of the query's own vec_id is no candidate. Every
    vector is coded; estimates come from the packed bits (queries rounded to 8 bits a component) and the correction
    scalars, and a vector is reranked on the original numbers if the upper bounds of its estimates, by one code and then by more, reach the k-th best score
    that its partition has seen. A bound is four standard deviations wide, so a neighbour is missed with a probability of some 0.00003 where it is the last of the k, and less where it is nearer. Queries go in blocks of ``query_block``, each broadcast to one pass over the codes;
    a pass sends k rows per query and partition to the final choice, so no group is gathered whole.

    Vectors that are null, all zero, of another length than the most frequent one, or have null or non-finite
    components take no part, nor do rows without a vec_id. Returns query_id, rank (from 1), vec_id, score (double
    precision on the original vectors, components added in order); ties go to the smaller vec_id. Rows with equal
    vec_id are candidates each. Empty tables give no rows.
    """
    spark = embeddings.sparkSession
    schema = "query_id long, vec_id long, score double"
    dim = _dimension(embeddings, vector)
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    centre = _centre(embeddings, vector, dim)
    index = cut(build_index(embeddings, vec_id, vector, dim, centre))
    asked = cut(build_index(queries, vec_id, vector, dim, centre).select("vec_id", "vector"))
    blocks = max(1, -(-asked.count() // query_block))
    block_of = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    found = None
    for b in range(blocks):
        rows = asked.where(block_of == b).orderBy("vec_id").toArrow()
        ids = rows.column("vec_id").to_numpy()
        if not len(ids):
            continue
        vectors = np.frombuffer(b"".join(rows.column("vector").to_pylist()), np.float64).reshape(-1, dim)
        shipped = spark.sparkContext.broadcast(QueryBlock(ids, vectors, centre))
        part = index.mapInArrow(_search(shipped, k, dim), schema)
        found = part if found is None else found.unionAll(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
