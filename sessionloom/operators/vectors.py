"""Feature vectors of sessions and prompts, and search by cosine similarity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

from sessionloom.functions import cosine, normalized
from sessionloom.operators.trust import numbered

#: The order of a vector's features, and which are scaled by log(1 + x).
SESSION_VECTOR = ("workflow_entropy", "retry_burst_score", "tool_switch_frequency", "edit_after_accept_ratio", "avg_read_before_ask", "avg_retry_distance", "context_expansion_speed", "workflow_length", "accept_rate", "retry_rate")
SESSION_LOGS = ("avg_read_before_ask", "avg_retry_distance", "context_expansion_speed", "workflow_length", "retry_rate")
PROMPT_VECTOR = ("prompt_density", "history_ratio", "token_count", "retrieved_files", "retrieved_symbols")
PROMPT_LOGS = ("token_count", "retrieved_files", "retrieved_symbols")


def _vector(names: tuple[str, ...], logs: tuple[str, ...]):
    parts = [F.when(F.col(n) > 0, F.log1p(n)).otherwise(0.0) if n in logs else F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names]
    return normalized(F.array(*parts))


def session_vectors(view: DataFrame) -> DataFrame:
    """Unit vectors from a session view."""
    return view.select("session_id", _vector(SESSION_VECTOR, SESSION_LOGS).alias("vector"))


def prompt_vectors(prompts: DataFrame) -> DataFrame:
    return prompts.select("prompt", _vector(PROMPT_VECTOR, PROMPT_LOGS).alias("vector"))


def top_similar(vectors: DataFrame, query: list[float], k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k rows most similar to one query vector: a projection and a bounded top-k per partition, no exchange of rows."""
    target = F.lit([float(x) for x in query])
    return vectors.select(key, cosine(F.col(vector), target).alias("similarity")).orderBy(F.desc("similarity"), key).limit(k)


def similar_to(vectors: DataFrame, entity, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k rows most similar to the one with this key, itself left out; nothing for an unknown key."""
    one = vectors.where(F.col(key) == F.lit(entity)).select(F.col(vector).alias("target")).limit(1)
    rest = vectors.where(F.col(key) != F.lit(entity)).crossJoin(F.broadcast(one))
    return rest.select(key, cosine(F.col(vector), F.col("target")).alias("similarity")).orderBy(F.desc("similarity"), key).limit(k)


#: Rows that one pass broadcasts, about: rows are dealt to passes by a hash of their key. Beyond so many bytes of vectors a pass has fewer.
PASS_ROWS = 4_096
PASS_BYTES = 32 << 20
#: Numbers of a matrix of rows by broadcast rows that a task has at a time, and neighbours that it keeps for all queries of a pass.
SLICE_CELLS = 1 << 20
PASS_FOUND = 1 << 19


def _slices(n: int, across: int) -> list[slice]:
    """Rows of a batch, as many at a time as SLICE_CELLS allows beside so many broadcast rows."""
    step = max(1, SLICE_CELLS // max(across, 1))
    return [slice(at, min(at + step, n)) for at in range(0, n, step)]


def _passes(rows: DataFrame, key: str, vector: str, most: int | None = None) -> list[DataFrame]:
    """Parts of the rows, each of about PASS_ROWS rows, or ``most``, or fewer if their vectors are long: what one broadcast holds."""
    n, longest = rows.agg(F.count("*"), F.max(F.size(vector))).first()
    passes = max(1, -(-n // min(PASS_ROWS, most or PASS_ROWS)), -(-n * max(longest or 0, 1) * 8 // PASS_BYTES))
    return [rows.where(F.pmod(F.xxhash64(key), F.lit(passes)) == k) if passes > 1 else rows for k in range(passes)]


def _matrix(column, width: int) -> np.ndarray:
    """An Arrow column of lists as a matrix; lists of another length, or with nulls, become rows of nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values, sizes = column.values, np.diff(column.offsets.to_numpy())
    if (sizes == width).all() and not values.null_count and not column.null_count:
        return values.to_numpy(zero_copy_only=False).astype(np.float64)[column.offsets[0].as_py() : column.offsets[-1].as_py()].reshape(-1, width)
    return np.array([x if x is not None and len(x) == width and None not in x else [np.nan] * width for x in column.to_pylist()], np.float64).reshape(-1, width)


def _exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of opposite rows, summed from the first component on, as the column function does."""
    dot = lambda x, y: np.add.accumulate(x * y, axis=1)[:, -1]
    size = np.sqrt(dot(a, a)) * np.sqrt(dot(b, b))
    return np.where(size > 0, dot(a, b) / np.where(size > 0, size, 1), 0.0)


def nearest_by_cosine(train: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", keep: str = "label", leave_out: bool = True) -> DataFrame:
    """(query, <key>, <keep>, d, r): the k rows nearest to each query by cosine distance (at least 1e-10), ties to the smaller key; with leave_out a row of the query's own key is left out.

    Queries are broadcast in passes; in each a task multiplies its rows with them, a slice of a batch at a time, and keeps k rows a query and those that tie with them, whose distances
    are then worked out in order. What is exchanged is k rows a query and task. Work is rows x queries. Vectors of another length than the first query's, or with nulls, take no part.
    """
    out = None
    schema = f"query {queries.schema[key].dataType.simpleString()}, {key} {train.schema[key].dataType.simpleString()}, {keep} {train.schema[keep].dataType.simpleString()}, d double"
    first = queries.where(F.col(vector).isNotNull()).select(F.size(vector)).first()
    width = first[0] if first else 0
    for some in _passes(queries.select(key, vector), key, vector, max(1, PASS_FOUND // k)):
        found = some.where(F.size(vector) == width).collect()
        names = [r[0] for r in found]
        asked = np.array([r[1] for r in found], np.float64).reshape(len(found), width)
        fine = np.isfinite(asked).all(1) if len(found) else np.zeros(0, bool)
        shipped = train.sparkSession.sparkContext.broadcast(([n for n, f in zip(names, fine) if f], asked[fine]))

        def search(batches):
            names, asked = shipped.value
            length = np.sqrt((asked * asked).sum(1))
            unit = asked / np.where(length > 0, length, 1)[:, None]
            place = {n: i for i, n in enumerate(names)}
            # the best so far of each query: query, key, keep, distance
            best: list[list[tuple]] = [[] for _ in names]
            limit = np.full(len(names), np.inf)
            for batch in batches:
                if not names:
                    continue
                whole = _matrix(batch.column(2), width)
                for part in _slices(len(whole), len(names)):
                    x, keys, kept = whole[part], batch.column(0)[part.start : part.stop].to_pylist(), batch.column(1)[part.start : part.stop].to_pylist()
                    size = np.sqrt((x * x).sum(1))
                    near = unit @ (x / np.where(size > 0, size, 1)[:, None]).T
                    np.subtract(1, near, out=near)
                    near[:, ~np.isfinite(x).all(1)] = np.inf
                    if leave_out:
                        for j, own in enumerate(keys):
                            if own in place:
                                near[place[own], j] = np.inf
                    for q in np.flatnonzero(near.min(1) <= limit + 1e-9).tolist():
                        at = np.flatnonzero(np.isfinite(near[q]) & (near[q] <= limit[q] + 1e-9))
                        if len(at) > k:
                            at = at[near[q, at] <= np.partition(near[q, at], k - 1)[k - 1] + 1e-9]
                        exact = np.maximum(1 - _exact_cosine(x[at], np.broadcast_to(asked[q], (len(at), width))), 1e-10)
                        best[q] = sorted(best[q] + [(d, keys[j], kept[j]) for d, j in zip(exact.tolist(), at.tolist())], key=lambda t: t[:2])[:k]
                        if len(best[q]) == k:
                            limit[q] = best[q][-1][0]
            rows = [(n, own, label, d) for n, found in zip(names, best) for d, own, label in found]
            columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        fields = train.select(F.col(key).cast(queries.schema[key].dataType).alias("query"), key, keep, F.lit(0.0).alias("d")).schema
        arrow = to_arrow_schema(fields)
        part = train.select(key, keep, vector).where(F.col(vector).isNotNull()).mapInArrow(search, schema)
        out = part if out is None else out.unionAll(part)
    ranked = out.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("d", key)))
    return ranked.where(F.col("r") <= k)


def knn_shares(train: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", label: str = "label", leave_out: bool = True) -> DataFrame:
    """(query, <label>, p): shares of the labels of each query's k nearest by cosine distance, weighted by exp(-d^2 / s^2), where s is the upper median of the k distances."""
    ranked = nearest_by_cosine(train, queries, k, key, vector, label, leave_out)
    whole = Window.partitionBy("query")
    weighted = ranked.withColumn("n", F.count("*").over(whole)).withColumn("s", F.max(F.when(F.col("r") == F.floor(F.col("n") / 2) + 1, F.col("d"))).over(whole))
    votes = weighted.withColumn("w", F.exp(-(F.col("d") * F.col("d")) / (F.col("s") * F.col("s")))).groupBy("query", label).agg(F.sum("w").alias("w"))
    return votes.select("query", label, (F.col("w") / F.sum("w").over(Window.partitionBy("query"))).alias("p"))


#: Numbers of the rows' vectors that every task may hold (128 MB), and rows that ask from one vector at a time.
HELD_NUMBERS, ASKED = 1 << 24, 1 << 12
#: Rows by which a query's bound is guessed, queries and rows that are multiplied at a time, and what single precision may be off.
GUESSED, SCAN_QUERIES, SCAN_ROWS, OFF = 1 << 12, 32, 1 << 15, 4e-6


class Neighbours:
    """Rows (vectors, labels, ranks of their keys) that are searched by cosine distance."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, ranks: np.ndarray, k: int):
        self.x, self.labels, self.ranks, self.k = x, labels, ranks, k
        self.size = np.sqrt(self._dot(x, x))
        self.unit = self._unit(x, self.size)
        n = len(x)
        self.guess = np.random.default_rng(0).permutation(n)[:GUESSED]
        share = (k + 1) * len(self.guess) / max(n, 1)
        # so many of the rows of the guess are surely more than k + 1 of all
        self.nth = int(share + 4 * np.sqrt(share) + 6)

    @staticmethod
    def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Summed from the first component on, as the column function does."""
        out = a[:, 0] * b[..., 0]
        for i in range(1, a.shape[1]):
            out = out + a[:, i] * b[..., i]
        return out

    @staticmethod
    def _unit(x: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (x / np.where(size > 0, size, 1)[:, None]).astype(np.float32)

    def _exact(self, at: np.ndarray | slice, query: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of some rows the k + 1 nearest in order: distance, rank and label."""
        both = self.size[at] * size
        d = np.maximum(1 - np.where(both > 0, self._dot(self.x[at], query) / np.where(both > 0, both, 1), 0.0), 1e-10)
        ranks, labels = self.ranks[at], self.labels[at]
        if len(d) > self.k + 1:
            near = np.flatnonzero(d <= np.partition(d, self.k)[self.k])
            d, ranks, labels = d[near], ranks[near], labels[near]
        order = np.lexsort((ranks, d))[: self.k + 1]
        return d[order], ranks[order], labels[order]

    def search(self, queries: np.ndarray):
        """Of each query the k + 1 nearest rows. Products in single precision leave out what is surely farther; what stays is worked out in order."""
        size = np.sqrt(self._dot(queries, queries))
        unit = self._unit(queries, size)
        for first in range(0, len(queries), SCAN_QUERIES):
            some = unit[first : first + SCAN_QUERIES]
            hits = enough = None
            if len(self.x) > len(self.guess) and self.nth < len(self.guess):
                bound = np.partition(some @ self.unit[self.guess].T, len(self.guess) - self.nth, axis=1)[:, len(self.guess) - self.nth]
                found, enough = [], np.zeros(len(some), int)
                for at in range(0, len(self.x), SCAN_ROWS):
                    near = some @ self.unit[at : at + SCAN_ROWS].T
                    place = np.flatnonzero(near >= (bound - np.float32(OFF))[:, None])
                    q = place // near.shape[1]
                    enough += np.bincount(q[near.reshape(-1)[place] >= bound[q]], minlength=len(some))
                    found.append((q, place % near.shape[1] + at))
                q, row = (np.concatenate(c) for c in zip(*found))
                order = np.argsort(q, kind="stable")
                hits = np.split(row[order], np.searchsorted(q[order], np.arange(1, len(some))))
            for i in range(len(some)):
                # where the guess was too narrow, all rows are looked at
                yield self._exact(hits[i] if hits is not None and enough[i] > self.k else slice(None), queries[first + i], size[first + i])

    def shares(self, d: np.ndarray, ranks: np.ndarray, labels: np.ndarray, asked: list) -> list[list[tuple]]:
        """For each that asks, by its rank or None, the shares of the labels among its k nearest: those in the list without itself, or without the last."""
        place = {r: i for i, r in enumerate(ranks.tolist())}
        out, known = [], {}
        for own in asked:
            without = place.get(own, self.k)
            if without not in known:
                n = len(d) - (without < len(d))
                middle = n // 2 + (n // 2 >= without)
                if n:
                    w = np.exp(-(d * d) / (d[middle] * d[middle]))
                    kept = np.arange(len(d)) != without
                    by = [(label, w[kept & (labels == label)]) for label in np.unique(labels[kept]).tolist()]
                    total = sum(float(v.sum()) for _, v in by)
                known[without] = [(label, float(v.sum()) / total) for label, v in by] if n else []
            out.append(known[without])
        return out


def _shares_in_tasks(train: DataFrame, queries: DataFrame, k: int, key: str, vector: str, label: str, leave_out: bool) -> DataFrame | None:
    """As ``shares_by_vector``: each task holds all rows' vectors and searches for its own queries, so that no neighbours are exchanged. None where the vectors are more than HELD_NUMBERS."""
    n, width = train.agg(F.count("*"), F.max(F.size(vector))).first()
    if not n or n * max(width, 1) > HELD_NUMBERS or not isinstance(train.schema[label].dataType, IntegralType):
        return None
    rows = numbered(train.select(key, vector, label), [key], "rank").checkpoint()
    told = rows.select("rank", label, vector).toArrow()
    x = _matrix(told.column(2), width)
    fine = np.isfinite(x).all(1)
    held = Neighbours(x[fine], told.column(1).to_numpy()[fine], told.column(0).to_numpy()[fine], k)
    shipped = train.sparkSession.sparkContext.broadcast(held)
    each = queries.select(key, vector)
    each = each.join(rows.select(key, "rank"), key, "left") if leave_out else each.withColumn("rank", F.lit(None).cast("bigint"))
    part = F.floor((F.row_number().over(Window.partitionBy(vector).orderBy(key)) - 1) / ASKED)
    places = each.withColumn("part", part).groupBy(vector, "part").agg(F.collect_list(F.struct(key, "rank")).alias("asked")).select(vector, "asked").repartition(4 * train.sparkSession.sparkContext.defaultParallelism)
    names = [f"query {queries.schema[key].dataType.simpleString()}", f"{label} {train.schema[label].dataType.simpleString()}", "p double"]
    fields = queries.select(F.col(key).alias("query")).join(train.select(label), F.lit(True)).select("query", label, F.lit(0.0).alias("p")).schema
    arrow = to_arrow_schema(fields)

    def ask(batches):
        held = shipped.value
        for batch in batches:
            x = _matrix(batch.column(0), held.x.shape[1])
            fine = np.flatnonzero(np.isfinite(x).all(1))
            out: list[tuple] = []
            for i, found in zip(fine.tolist(), held.search(x[fine])):
                asked = batch.column(1)[i].as_py()
                for who, shares in zip(asked, held.shares(*found, [a["rank"] for a in asked])):
                    out += [(who[key], *s) for s in shares]
            columns = list(zip(*out)) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return places.mapInArrow(ask, ", ".join(names))


def shares_by_vector(train: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", label: str = "label", leave_out: bool = True) -> DataFrame:
    """As ``knn_shares``, for rows of which many have equal vectors: work is different vectors of queries x different vectors (and labels) of rows.

    While the rows' vectors fit a task (HELD_NUMBERS), each task searches all of them for its own queries (``_shares_in_tasks``). Of more, queries go round in passes, and then:
    of rows with one vector and label the k + 1 of smallest keys can be among k neighbours. Equal vectors of queries have the same k + 1 nearest rows, of which a query has all but one: itself if it is there, else the last.
    """
    train, queries = train.where(F.col(vector).isNotNull()), queries.where(F.col(vector).isNotNull())
    found = _shares_in_tasks(train, queries, k, key, vector, label, leave_out)
    if found is not None:
        return found
    by_key = Window.partitionBy(vector, label).orderBy(key)
    members = train.where(F.col(vector).isNotNull()).select(key, label, vector, F.row_number().over(by_key).alias("nth"), F.first(key).over(by_key).alias("first")).where(F.col("nth") <= k + 1).checkpoint()
    spots = members.groupBy(F.col("first").alias(key), label).agg(F.first(vector).alias(vector), F.count("*").alias("m"))
    asked = queries.where(F.col(vector).isNotNull()).select(key, vector)
    places = asked.groupBy(vector).agg(F.min(key).alias("place")).checkpoint()
    near = nearest_by_cosine(spots.drop("m"), places.withColumnRenamed("place", key), k + 1, key, vector, label, leave_out=False).withColumnRenamed("query", "place").withColumnRenamed(key, "first")
    # rows that are nearer than a spot: k + 1 of them, and it has no part
    nearer = Window.partitionBy("place").orderBy("d").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    level = Window.partitionBy("place", "d")
    cut = near.join(spots.select(F.col(key).alias("first"), "m"), "first").withColumn("nearer", F.sum("m").over(nearer) - F.sum("m").over(level)).where(F.col("nearer") <= k)
    ranked = cut.select("place", "first", label, "d").join(members.select("first", key), "first").withColumn("r", F.row_number().over(Window.partitionBy("place").orderBy("d", key))).where(F.col("r") <= k + 1)
    listed = ranked.withColumn("without", F.min("r").over(Window.partitionBy("place", "first"))).checkpoint()
    each = asked.join(places, vector).select(key, "place")
    own = F.col("without") if leave_out else F.lit(None).cast("int")
    each = each.join(listed.select("place", key, own.alias("without")), ["place", key], "left").withColumn("without", F.coalesce("without", F.lit(k + 1))).checkpoint()
    whole = Window.partitionBy("place", "without")
    kept = each.select("place", "without").distinct().join(listed.select("place", label, "d", "r"), "place").where("r <> without").withColumn("r", F.col("r") - (F.col("r") > F.col("without")).cast("int"))
    weighted = kept.withColumn("n", F.count("*").over(whole)).withColumn("s", F.max(F.when(F.col("r") == F.floor(F.col("n") / 2) + 1, F.col("d"))).over(whole))
    votes = weighted.groupBy("place", "without", label).agg(F.sum(F.exp(-(F.col("d") * F.col("d")) / (F.col("s") * F.col("s")))).alias("w"))
    shares = votes.withColumn("p", F.col("w") / F.sum("w").over(whole))
    return each.join(shares, ["place", "without"]).select(F.col(key).alias("query"), label, "p")


def knn_vote(train: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """The label with the largest of ``knn_shares`` for each query, the query itself left out; ties go to the smaller label."""
    best = knn_shares(train, queries, k, key, vector, label).groupBy("query").agg(F.max_by(F.struct(label, "p"), F.struct("p", -F.col(label))).alias("b"))
    return best.select("query", F.col(f"b.{label}").alias("predicted"), F.col("b.p").alias("confidence"))


def affinity_sums(rows: DataFrame, others: DataFrame, classes: int, sigma: float = 1.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each row the sum ``total`` of its affinities exp(-d^2 / (2 sigma^2)) to all others, and s0, s1, ... of affinity times each of the ``p`` of others.

    ``others`` has other (a key), o (a vector) and p, and may have m, how many rows of that vector and p it stands for: a row of the same key then has m - 1 others there. They are broadcast in passes; a task multiplies
    its rows with them, a slice of a batch at a time, and keeps sums per row only, in a checkpoint if there is more than one pass. Work is rows x others. Rows that have no other are left out.
    """
    others = others if "m" in others.columns else others.withColumn("m", F.lit(1).cast("bigint"))
    names = ["total"] + [f"s{i}" for i in range(classes)]
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, " + ", ".join(f"{n} double" for n in names) + ", others long"
    sums = None
    passes = _passes(others.select("other", "o", "p", "m"), "other", "o")
    for some in passes:
        found = some.where("o IS NOT NULL").collect()
        width = len(found[0]["o"]) if found else 0
        shipped = rows.sparkSession.sparkContext.broadcast(
            ([r["other"] for r in found], np.array([r["o"] for r in found], np.float64).reshape(-1, width), np.array([r["p"] for r in found], np.float64).reshape(-1, classes), np.array([r["m"] for r in found], np.float64))
        )

        def affine(batches):
            known, o, p, m = shipped.value
            place: dict = {}
            for i, n in enumerate(known):
                place.setdefault(n, []).append(i)
            square = (o * o).sum(1)
            # what w is multiplied with: the number of rows, and that times each of p
            of = np.column_stack([m, m[:, None] * p])
            for batch in batches:
                if not known:
                    continue
                whole, keys = _matrix(batch.column(1), o.shape[1]), batch.column(0).to_pylist()
                sums, own = np.empty((len(keys), classes + 1)), np.full(len(keys), int(m.sum()))
                for part in _slices(len(keys), len(known)):
                    x = whole[part]
                    w = x @ o.T
                    w *= 2
                    w -= square
                    w -= (x * x).sum(1)[:, None]
                    np.minimum(w, 0, out=w)
                    w /= 2 * sigma * sigma
                    np.exp(w, out=w)
                    for j, n in enumerate(keys[part]):
                        if n in place:
                            w[j, place[n]] *= 1 - 1 / m[place[n]]
                            own[part.start + j] -= len(place[n])
                    sums[part] = w @ of
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in sums.T.copy()), pa.array(own)], names=[key, *names, "others"])

        part = rows.select(key, vector).where(F.col(vector).isNotNull()).mapInArrow(affine, schema)
        sums = part if sums is None else sums.unionAll(part)
        if len(passes) > 1:
            sums = sums.groupBy(key).agg(*[F.sum(c).alias(c) for c in (*names, "others")]).checkpoint()
    return sums.groupBy(key).agg(*[F.sum(c).alias(c) for c in names], F.sum("others").alias("others")).where("others > 0").drop("others")


def propagation_step(rows: DataFrame, labels: list[int], sigma: float = 1.0, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One step of label propagation: anchors (label not null) keep theirs, others get the affinity-weighted mean of all others' distributions.

    Rows that share a key give one row, with the largest label among them. Affinity is exp(-d^2 / (2 sigma^2)); see ``affinity_sums`` for how any number of rows is gone through.
    """
    one_hot = F.array(*[F.when(F.col(label) == k, 1.0).when(F.col(label).isNull(), 1.0 / len(labels)).otherwise(0.0) for k in labels])
    sums = affinity_sums(rows, rows.select(F.col(key).alias("other"), F.col(vector).alias("o"), one_hot.alias("p")), len(labels), sigma, key, vector)
    sums = sums.join(rows.groupBy(key).agg(F.max(label).alias("own")), key)
    mean = [F.when(F.col("own").isNull(), F.when(F.col("total") > 0, F.col(f"s{i}") / F.col("total")).otherwise(0.0)).when(F.col("own") == k, 1.0).otherwise(0.0) for i, k in enumerate(labels)]
    return sums.select(key, F.array(*mean).alias("distribution"))
