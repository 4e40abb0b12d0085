"""Packing token pieces into fixed-length sequences by exact-complement hashing on the histogram of lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionloom.llm.common import stash, steps, text_or_empty, tidy
from sessionloom.llm.tokens import encoder

#: A kind of sequence: the lengths in it, in order, and how many sequences are of the kind.
Pattern = tuple[tuple[int, ...], int]


class SumIndex:
    """For each sum of lengths a combination of one, two or three lengths of which there are pieces, with the largest first, so that short pieces last.

    An entry holds until its pieces have run out. Counts only fall, so a sum that has no combination never gets one again.
    """

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.pairs: dict[int, tuple[int, ...] | None] = {}
        self.triples: dict[int, tuple[int, ...] | None] = {}

    def _there(self, lengths: tuple[int, ...] | None) -> bool:
        return lengths is not None and all(self.counts[x] >= lengths.count(x) for x in lengths)

    def single(self, total: int) -> tuple[int, ...] | None:
        return (total,) if self.counts[total] else None

    def _pair(self, total: int) -> tuple[int, ...] | None:
        large = np.arange((total + 1) // 2, total)
        large = large[(self.counts[large] > 0) & (self.counts[total - large] > np.where(2 * large == total, 1, 0))]
        return (int(large[-1]), total - int(large[-1])) if len(large) else None

    def pair(self, total: int) -> tuple[int, ...] | None:
        known = self.pairs.get(total, ())
        if known is not None and not (known and self._there(known)):
            known = self.pairs[total] = self._pair(total)
        return known

    def triple(self, total: int) -> tuple[int, ...] | None:
        known = self.triples.get(total, ())
        if known is not None and not (known and self._there(known)):
            known = None
            large = np.arange(-(-total // 3), total - 1)
            for first in large[self.counts[large] > 0][::-1].tolist():
                rest = self.pair(total - first)
                if rest and not self._there((first, *rest)):  # it takes the last piece of this length
                    self.counts[first] -= 1
                    rest = self._pair(total - first)
                    self.counts[first] += 1
                if rest:
                    known = (first, *rest)
                    break
            self.triples[total] = known
        return known

    def filling(self, gap: int) -> tuple[int, ...] | None:
        """What fills a gap: one piece, else two, else three."""
        return self.single(gap) or self.pair(gap) or self.triple(gap)


def _exact(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Consume, longest length first, what one, two or three other pieces fill up exactly; counts are reduced."""
    patterns: list[Pattern] = []
    index = SumIndex(counts)
    for length in range(capacity, 0, -1):
        while counts[length]:
            counts[length] -= 1
            others = index.filling(capacity - length) if length < capacity else ()
            counts[length] += 1
            if others is None:
                break
            lengths = (length, *others)
            need = np.bincount(lengths, minlength=len(counts))
            used = np.flatnonzero(need)
            n = int((counts[used] // need[used]).min())
            counts[used] -= n * need[used]
            patterns.append((tuple(sorted(lengths, reverse=True)), n))
    return patterns


def _best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best fit of what is left, longest first; sequences with the same contents are handled together."""
    open_: list[list[Pattern]] = [[] for _ in range(capacity + 1)]
    filled = np.zeros(capacity + 1, bool)
    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            rooms = np.flatnonzero(filled[length:])
            if not len(rooms):
                each = capacity // length
                full, rest = divmod(left, each)
                for n, per in ((full, each), (1, rest)):
                    if n and per:
                        room = capacity - per * length
                        open_[room].append(((length,) * per, n))
                        filled[room] = True
                left = 0
                continue
            room = int(rooms[0]) + length
            lengths, n = open_[room].pop()
            used = min(n, left)
            if used < n:
                open_[room].append((lengths, n - used))
            filled[room] = bool(open_[room])
            open_[room - length].append((lengths + (length,), used))
            filled[room - length] = True
            left -= used
    return [p for kinds in open_ for p in kinds]


def plan_packing(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Patterns that place every piece: counts[n] pieces have length n, 1 <= n <= capacity.

    Exact fillings come first, then best fit for the rest. The last fillings, of the shortest pieces, may have used up what best fit
    needs, so as few of them as give the fewest sequences are undone: none, one, two, four and so on.
    """
    left = np.array(counts, np.int64)
    exact = _exact(left, capacity)
    least = -(-int((np.asarray(counts, np.int64) * np.arange(len(counts))).sum()) // capacity)
    best, undone = None, 0
    while True:
        kept, rest, again = [], left.copy(), undone
        for lengths, n in reversed(exact):
            back = 0 if lengths == (capacity,) else min(n, again)
            again -= back
            np.add.at(rest, list(lengths), back)
            if n > back:
                kept.append((lengths, n - back))
        plan = kept[::-1] + _best_fit(rest, capacity)
        total = sum(n for _, n in plan)
        if best is None or total < best[0]:
            best = total, plan
        if best[0] <= least or again > 0:
            return best[1]
        undone = max(1, undone * 2)


def _slots(patterns: list[Pattern], capacity: int) -> tuple[np.ndarray, ...]:
    """For each length and run of ranks: the first rank, the sequence of it, and the place in the sequence."""
    next_rank = np.zeros(capacity + 1, np.int64)
    rows, sequence = [], 0
    for lengths, n in patterns:
        at = 0
        for length in lengths:
            rows.append((length, next_rank[length], sequence, at))
            next_rank[length] += n
            at += length
        sequence += n
    return tuple(np.array(sorted(rows), np.int64).reshape(-1, 4).T)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long"


def token_pieces(documents: DataFrame, tokenizer_file: str, text: str = "text", doc_id: str = "doc_id", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Every document's ids and the end id, cut into pieces of ``capacity``: ids, places, lengths and checksums; with the piece's partition and its rank among that partition's pieces of equal length."""
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("t"))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        codes = encoder(tokenizer_file)
        for batch in batches:
            for rows_, data, offsets in steps(batch, "t"):
                ids, ends = codes.encode(data, offsets)
                out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "crc", "rank")}
                for k, doc in enumerate(rows_.column("doc_id").to_pylist()):
                    own = np.append(ids[ends[k] : ends[k + 1]], np.uint32(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(own), capacity)):
                        some = own[start : start + capacity]
                        for name, v in (("doc_id", doc), ("piece", piece), ("start", start), ("length", len(some)), ("crc", zlib.crc32(some.tobytes())), ("rank", int(seen[len(some)]))):
                            out[name].append(v)
                        seen[len(some)] += 1
                n = len(out["doc_id"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out["doc_id"], pa.int64()), pa.array(out["piece"], pa.int32()), *(pa.array(out[c], pa.int64()) for c in ("start", "length", "crc")), pa.array(np.full(n, part), pa.int32()), pa.array(out["rank"], pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "local_rank"],
                )

    return rows.mapInArrow(tidy(cut_up), PIECES)


def pack(documents: DataFrame, tokenizer_file: str, text: str = "text", doc_id: str = "doc_id", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pack all documents' tokens into as few sequences of at most ``capacity`` as the method can.

    Only documents longer than ``capacity`` are cut, into pieces of that length. The plan needs nothing but how many
    pieces have each length, ``capacity`` numbers whatever the corpus: single, pair and triple length sums that fill
    a gap exactly are looked up and consumed first, then the rest goes by best fit. The plan says which ranks within a length go where;
    a piece's rank is its rank in its partition plus the pieces of that length in earlier ones, so no length is
    gathered in a task, however many pieces share it. Pieces are written to the shared folder once and tokenised once.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text is the end id alone;
    repeated rows are packed each; an empty table gives no rows. Other columns are ignored.
    """
    spark = documents.sparkSession
    pieces = stash(token_pieces(documents, tokenizer_file, text, doc_id, capacity, end_id))
    per_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r["length"]] = r["n"]
    shipped = spark.sparkContext.broadcast(_slots(plan_packing(counts, capacity), capacity))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_part.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local_rank")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, ranks, sequences, places = shipped.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            # lengths are below 2**15 or so and ranks below 2**47: one number orders both
            at = np.searchsorted((lengths << 47) | ranks, (length << 47) | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequences[at] + rank - ranks[at]), pa.array(places[at])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(tidy(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
