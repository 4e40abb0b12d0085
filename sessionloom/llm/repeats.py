"""Exact removal of repeated byte strings across documents, by suffix arrays of content-dealt shards, merged by binary search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sessionloom.llm.common import fresh_dir, mix, same_spans, span_hashes, steps, text_or_empty, tidy
from sessionloom.llm.suffix_arrays import common_prefixes, occurs, suffix_array

LENGTH = 100
#: Bytes of the grams whose least hash in a window says to which shard the window goes.
GRAM = 20
#: Windows of a run at most.
RUN = 512
#: Bytes of runs in one suffix array.
SHARD_BYTES = 1 << 19
#: Different runs of one least gram beyond which its windows are dealt one by one, by all their bytes.
SPREAD = 2048
#: Text bytes that one partition of runs stands for.
PART_BYTES = 16 << 20

_BYTE_HASH = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` bytes, put together from runs of one, two, four bytes and so on."""
    done, have, part, width, base = None, 0, _BYTE_HASH[data], 1, 0x9E3779B97F4A7C15
    while True:
        if size & width:
            # append this width to what there is
            if done is None:
                done = part
            else:
                m = len(part) - have
                done = done[:m] * np.uint64(base) + part[have : have + m] if m > 0 else np.zeros(0, np.uint64)
            have += width
        if have == size:
            return mix(done[: max(0, len(data) - size + 1)])
        m = len(part) - width
        part = part[:m] * np.uint64(base) + part[width:] if m > 0 else np.zeros(0, np.uint64)
        base = base * base % (1 << 64) | 1
        width *= 2


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring values."""
    n, reach = len(values) - width + 1, 1
    if n <= 0:
        return values[:0]
    while reach * 2 <= width:
        values = np.minimum(values[: len(values) - reach], values[reach:])
        reach *= 2
    return np.minimum(values[:n], values[width - reach : width - reach + n])


def _own_repeats(grams: np.ndarray, least: np.ndarray, valid: np.ndarray, start: np.ndarray, reach: int) -> np.ndarray:
    """Which runs may repeat themselves: those with two neighbouring places of a least gram in one window or in windows next to each other (a text of a short period)."""
    edge = np.zeros(reach - 1, np.uint64)
    most = ~sliding_least(~np.concatenate([edge, np.where(valid, least, 0), edge]), reach)
    places = np.flatnonzero(most == grams)
    twin = np.flatnonzero((grams[places[1:]] == grams[places[:-1]]) & (np.diff(places) <= reach))
    marks = np.zeros(len(start) + 1, np.int64)
    if len(twin):
        np.add.at(marks, np.maximum(np.searchsorted(start, places[twin + 1] - reach + 1, side="right") - 1, 0), 1)
        np.add.at(marks, np.searchsorted(start, places[twin], side="right"), -1)
    return np.cumsum(marks[:-1]) > 0


def window_runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows of ``length`` bytes that have the same least gram: text, first window, number of windows, least gram, 128-bit BLAKE2 digest of the bytes covered (two numbers a run), and if the run may repeat itself.

    Every window is in one run, and equal windows have equal least grams, in whatever texts they are.
    """
    n = len(data)
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty, empty, empty, empty, empty.reshape(0, 2), empty.astype(bool)
    grams = gram_hashes(data, gram)
    least = sliding_least(grams, length - gram + 1)
    ok = np.zeros(len(least) + 1, np.int32)
    from_, to = offsets[:-1], np.maximum(offsets[1:] - length + 1, offsets[:-1])
    some = to > from_
    np.add.at(ok, from_[some], 1)
    np.add.at(ok, to[some], -1)
    valid = np.cumsum(ok[:-1]) > 0
    begins = valid.copy()
    begins[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    begins[from_[some]] = True
    start = np.flatnonzero(begins)
    stop = np.append(start[1:], len(least))
    text = np.searchsorted(offsets, start, side="right") - 1
    stop = np.minimum(stop, to[text])
    own = _own_repeats(grams, least, valid, start, length - gram + 1)
    pieces = -(-(stop - start) // RUN)
    if (pieces > 1).any():
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        text, start, stop = np.repeat(text, pieces), np.repeat(start, pieces) + nth * RUN, np.repeat(stop, pieces)
        stop, own = np.minimum(stop, start + RUN), np.repeat(own, pieces)
    raw, digest = memoryview(data.tobytes()), hashlib.blake2b
    content = b"".join([digest(raw[i:j], digest_size=16).digest() for i, j in zip(start.tolist(), (stop - 1 + length).tolist())])
    return text, start - offsets[text], stop - start, least[start].view(np.int64), np.frombuffer(content, np.int64).reshape(-1, 2), own


#: Added to a run's number of windows if it may repeat itself.
OWN = 1 << 20

RUNS = "doc long, start int, windows int, least long, content long, content_low long"
#: kind: 0 all windows repeat earlier ones; 1 to be looked into, dealt by the least gram; 2 the same, dealt by window
SORTED = "doc long, start int, windows int, least long, kind int"


def _batch(schema: str, *columns) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names, kinds = zip(*(f.split() for f in schema.split(", ")))
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, types[k]) for c, k in zip(columns, kinds)], names=list(names))


def _gather(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    got = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(got) if got else None


def _columns(table: pa.Table | pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy() for n in names]


def _equal_runs(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Of rows in ``order``: which agree in all keys with the one before."""
    same = np.zeros(len(order), bool)
    same[1:] = True
    for key in keys:
        key = key[order]
        same[1:] &= key[1:] == key[:-1]
    return same


def _later(order: np.ndarray, same: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in ``order`` (by group, doc, start), with ``same`` telling where a group goes on: the first of each group, and which rows start later than their group's first."""
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    d, s = doc[order], start[order]
    return ~same, (d > d[first]) | ((d == d[first]) & (s > s[first]))


def _sort_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's runs: equal ones after the first repeat it; where a least gram has several different ones, the first of each is to be looked into."""
    table = _gather(batches)
    if table is None:
        return
    doc, start, windows, least, content, low = _columns(table, "doc", "start", "windows", "least", "content", "content_low")
    done = windows < 0
    if done.any():
        yield _batch(SORTED, doc[done], start[done], -windows[done], least[done], np.zeros(done.sum(), np.int32))
        doc, start, windows, least, content, low = (c[~done] for c in (doc, start, windows, least, content, low))
    if not len(doc):
        return
    own, windows = windows >= OWN, windows & (OWN - 1)
    order = np.lexsort((start, doc, low, content, least))
    same = _equal_runs(order, least, content, low)
    first, later = _later(order, same, doc, start)
    rows = order[later]
    yield _batch(SORTED, doc[rows], start[rows], windows[rows], least[rows], np.zeros(len(rows), np.int32))
    heads = order[first]
    _, group, count = np.unique(least[heads], return_inverse=True, return_counts=True)
    several = (count[group] > 1) | own[heads]
    rows, many = heads[several], count[group][several] > SPREAD
    yield _batch(SORTED, doc[rows], start[rows], windows[rows], least[rows], np.where(many, 2, 1).astype(np.int32))


def _find_runs(length: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in steps(batch, "t"):
                text, start, windows, least, content, own = window_runs(data, offsets, length)
                if not len(text):
                    continue
                doc = rows.column("doc").to_numpy()[text]
                # what repeats an earlier run of this step travels as such, so no run of a hot group does so often
                order = np.lexsort((start, doc, content[:, 1], content[:, 0], least))
                same = _equal_runs(order, least, content[:, 0], content[:, 1])
                _, later = _later(order, same, doc, start)
                twin = same & ~later
                rest = order[~(later | twin)]
                yield _batch(RUNS, doc[rest], start[rest].astype(np.int32), windows[rest] + OWN * own[rest], least[rest], content[rest, 0], content[rest, 1])
                rows_ = order[later]
                if len(rows_):
                    # dealt by their own place: a negative count marks them
                    yield _batch(RUNS, doc[rows_], start[rows_], -windows[rows_], mix(doc[rows_].view(np.uint64) * np.uint64(31) + start[rows_].astype(np.uint64)).view(np.int64), content[rows_, 0], content[rows_, 1])

    return find


PARTS = "route long, doc long, start int, windows int, bytes binary"


def _single_windows(data: np.ndarray, at: np.ndarray, doc: np.ndarray, place: np.ndarray, length: int) -> Iterator[pa.RecordBatch]:
    """Windows that travel one by one, dealt by a hash of all their bytes. What repeats an earlier window of this step, byte for byte, travels as a run of settled windows without bytes."""
    hashed = span_hashes(data, at, at + length)
    order = np.lexsort((place, doc, hashed))
    same = _equal_runs(order, hashed)
    first = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    _, later = _later(order, same, doc, place)
    later &= same_spans(data, at[order], at[order] + length, data, at[first], at[first] + length)
    if later.any():
        runs = _as_runs(doc[order[later]], place[order[later]])
        d, s, n = _columns(runs, "doc", "start", "windows")
        yield _batch(PARTS, mix(d.view(np.uint64) * np.uint64(31) + s.astype(np.uint64)).view(np.int64), d, s, -n, [b""] * len(d))
    rest, raw = order[~later], data.tobytes()
    for k in range(0, len(rest), RUN * 8):
        some = rest[k : k + RUN * 8]
        yield _batch(PARTS, hashed[some].view(np.int64), doc[some], place[some].astype(np.int32), np.ones(len(some), np.int32), [raw[x : x + length] for x in at[some].tolist()])


def _take_bytes(length: int):
    """The bytes of the runs that are to be looked into: whole runs, dealt by their least gram; or single windows."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in steps(batch, "t"):
                single: list[tuple[np.ndarray, ...]] = []
                for doc, runs, a, b in zip(rows.column("doc").to_pylist(), rows.column("runs"), offsets[:-1].tolist(), offsets[1:].tolist()):
                    inner = runs.values
                    start, windows, least, kind = (inner.field(n).to_numpy() for n in ("start", "windows", "least", "kind"))
                    fits = start + windows + length - 1 <= b - a
                    plain = np.flatnonzero((kind == 1) & fits)
                    if len(plain):
                        raw = data[a:b].tobytes()
                        yield _batch(PARTS, least[plain], np.full(len(plain), doc), start[plain], windows[plain], [raw[s : s + w + length - 1] for s, w in zip(start[plain].tolist(), windows[plain].tolist())])
                    spread = np.flatnonzero((kind == 2) & fits)
                    if len(spread):
                        n = windows[spread].astype(np.int64)
                        place = np.repeat(start[spread] - np.cumsum(n) + n, n) + np.arange(n.sum())
                        single.append((place + a, np.full(len(place), doc), place))
                if single:
                    yield from _single_windows(data, *(np.concatenate(x) for x in zip(*single)), length)

    return take


def shard_windows(contents: list[bytes], doc: np.ndarray, start: np.ndarray, windows: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """A shard's text; and of its windows, in the order of their suffixes: place in the text, run, document, place there, and whether an equal window of the shard with a smaller (document, place) precedes it, by suffix array and common prefixes."""
    text = np.frombuffer(b"".join(contents), np.uint8)
    size = np.array([len(c) for c in contents], np.int64)
    begin = np.cumsum(size) - size
    array = suffix_array(text, length)
    shared = common_prefixes(text, array, length)
    group = np.cumsum(shared < length)
    run = np.searchsorted(begin, array, side="right") - 1
    within = array - begin[run]
    full = within < windows[run]
    array, group, run = array[full], group[full], run[full]
    d, s = doc[run], start[run] + within[full]
    order = np.lexsort((s, d, group))
    _, later = _later(order, _equal_runs(order, group), d, s)
    repeats = np.zeros(len(array), bool)
    repeats[order[later]] = True
    return text, array, run, d, s, repeats


COVERED = "doc long, start int, windows int"


def _as_runs(doc: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    if not len(doc):
        return _batch(COVERED, doc, place.astype(np.int32), place.astype(np.int32))
    edge = np.ones(len(doc), bool)
    edge[1:] = (doc[1:] != doc[:-1]) | (place[1:] > place[:-1] + 1)
    first = np.flatnonzero(edge)
    last = np.append(first[1:], len(doc)) - 1
    return _batch(COVERED, doc[first], place[first].astype(np.int32), (place[last] - place[first] + 1).astype(np.int32))


def _search_shards(length: int, shard_bytes: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs arrive sorted by route, document and place, and are cut into shards of ``shard_bytes``. A route that goes on from one shard to
        the next has its windows of the next looked up in the suffix orders of those before."""
        waiting: list[tuple[int, int, int, int, bytes]] = []
        held = 0
        last, twin = None, False
        before: list[tuple[np.ndarray, np.ndarray]] = []
        before_route = None

        def shard(goes_on: int | None) -> pa.RecordBatch:
            nonlocal before, before_route
            route, doc, start, windows = (np.array([w[k] for w in waiting], np.int64) for k in range(4))
            text, place, run, d, s, repeats = shard_windows([w[4] for w in waiting], doc, start, windows, length)
            if before and route[0] == before_route:
                asked = np.flatnonzero((route[run] == before_route) & ~repeats)
                for other, ordered in before:
                    hit = occurs(text, place[asked], other, ordered, length)
                    repeats[asked[hit]] = True
                    asked = asked[~hit]
            if goes_on is None or goes_on != before_route:
                before = []
            before_route = goes_on
            if goes_on is not None:
                kept = np.flatnonzero((route[run] == goes_on) & ~repeats)
                first = int(np.searchsorted(route, goes_on))
                cut = sum(len(w[4]) for w in waiting[:first])
                if len(kept):
                    before.append((text[cut:].copy(), place[kept] - cut))
            return _as_runs(d[repeats], s[repeats])

        for batch in batches:
            windows = batch.column("windows").to_numpy()
            settled = np.flatnonzero(windows < 0)
            if len(settled):
                doc, start = (batch.column(n).to_numpy()[settled] for n in ("doc", "start"))
                yield _batch(COVERED, doc, start, -windows[settled])
                batch = batch.take(pa.array(np.flatnonzero(windows > 0)))
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if last is not None:
                    same = row[0] == last[0]
                    # a window that travels alone, with no other of its route, has no equal one anywhere
                    if same or twin or last[3] > 1:
                        if held >= shard_bytes:
                            yield shard(last[0] if last[0] == waiting[-1][0] else None)
                            waiting, held = [], 0
                        waiting.append(last)
                        held += len(last[4])
                    twin = same
                last = row
        if last is not None and (twin or last[3] > 1):
            if held >= shard_bytes:
                yield shard(last[0] if last[0] == waiting[-1][0] else None)
                waiting = []
            waiting.append(last)
        if waiting:
            yield shard(None)

    return search


def repeated_spans(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """Of rows with doc (not null) and t (the text): (doc, start, windows), runs of windows of ``length`` bytes, each of which also starts earlier.

    Windows are put together to runs with the same least gram, which says where a run goes, so equal windows of any two
    texts meet in one shard or in shards that follow one another in one task; no other pair of shards has to be merged. Runs equal as a whole, by a 128-bit
    digest, are settled before and after that exchange: the first stays, the others repeat it. Where a gram has several different runs, their bytes are
    fetched (by a join that takes all columns of ``rows``, so that the caller can use its exchange again), and a shard of them gets a suffix array with common prefixes: suffixes that share ``length`` bytes are neighbours, and all but the
    earliest repeat it. Windows of a gram whose runs fill more than one shard are looked up in the suffix orders of the shards before, by binary search.
    A gram with over SPREAD different runs would fill a task; its windows travel one by one, each with its bytes, to shards dealt by a hash of all their bytes.
    """
    spark = rows.sparkSession
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))
    folder = fresh_dir(spark, "repeats")
    runs = rows.select("doc", "t").mapInArrow(tidy(_find_runs(length)), RUNS).repartition(parts, "least").mapInArrow(tidy(_sort_runs), SORTED)
    # files are made by few tasks that hold nothing else: the tasks that sort have texts in memory
    runs.hint("rebalance").write.parquet(folder)
    runs = spark.read.parquet(folder)
    unsettled = runs.where("kind > 0").groupBy("doc").agg(F.collect_list(F.struct("start", "windows", "least", "kind")).alias("runs"))
    looked = rows.join(unsettled, "doc").mapInArrow(tidy(_take_bytes(length)), PARTS)
    found = looked.repartition(parts, "route").sortWithinPartitions("route", "doc", "start").mapInArrow(tidy(_search_shards(length, SHARD_BYTES)), COVERED)
    return runs.where("kind = 0").select("doc", "start", "windows").unionAll(found)


def _settle(length: int, with_text: bool, schema: str):
    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in steps(batch, "t"):
                sizes, removed, spans, digests, texts = np.diff(offsets), [], [], [], []
                for runs, a, b in zip(rows.column("runs"), offsets[:-1].tolist(), offsets[1:].tolist()):
                    own = data[a:b]
                    if runs.is_valid and len(runs) and len(own) >= length:
                        start, windows = (runs.values.field(n).to_numpy().astype(np.int64) for n in ("start", "windows"))
                        edge = np.zeros(len(own) + 1, np.int64)
                        np.add.at(edge, np.minimum(start, len(own)), 1)
                        np.add.at(edge, np.minimum(start + windows + length - 1, len(own)), -1)
                        gone = np.cumsum(edge[:-1]) > 0
                        kept = own[~gone].tobytes()
                        removed.append(int(gone.sum()))
                        spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                    else:
                        kept = own.tobytes()
                        removed.append(0)
                        spans.append(0)
                    digests.append(hashlib.sha256(kept).hexdigest())
                    if with_text:
                        texts.append(kept.decode("utf-8", "ignore"))
                columns = [rows.column(c) for c in rows.schema.names if c not in ("t", "runs")] + [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(texts, pa.string())] if with_text else []), names=schema)

    return settle


def remove_repeats(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, keep: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """Remove each byte that a string of ``length`` bytes covers which also starts earlier: in a document of a smaller doc_id, or earlier in the same.

    Texts are UTF-8 bytes; a null text is empty; strings never cross documents and are judged on the input. Returns doc_id, the
    columns in ``keep``, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, if asked, kept_text, which leaves out what
    is left of a cut character. Rows that repeat a doc_id with the same text are one document told twice: each gets that document's result. Of different texts under one doc_id,
    the one with the smallest hash is the document; the others are left whole and nothing is compared with them. A null doc_id is the smallest.
    Columns in ``keep`` may have any name but those of results.
    """
    plain = {c: f"kept_{k}" for k, c in enumerate(c for c in keep if c != "doc_id")}
    rows = documents.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("doc"), F.col(doc_id).cast("long").alias("doc_id"), *[F.col(c).alias(k) for c, k in plain.items()], text_or_empty(text).alias("t")
    )
    hashed = rows.groupBy("doc").agg(F.min(F.xxhash64("t")).alias("least"), F.max(F.xxhash64("t")).alias("most")).where("least <> most")
    if hashed.isEmpty():
        told, rest = rows, None
    else:
        marked = rows.join(hashed.select("doc", "least"), "doc", "left").withColumn("main", F.coalesce(F.col("least") == F.xxhash64("t"), F.lit(True)))
        told, rest = marked.where("main").drop("least", "main"), marked.where("NOT main").drop("least", "main")
    spans = repeated_spans(told, length).groupBy("doc").agg(F.collect_list(F.struct("start", "windows")).alias("runs"))
    joined = told.join(spans, "doc", "left")
    if rest is not None:
        joined = joined.unionByName(rest.withColumn("runs", F.lit(None).cast(joined.schema["runs"].dataType)))
    joined = joined.drop("doc")
    fields = [f for f in joined.schema.fields if f.name not in ("t", "runs")]
    more = [("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string")] + ([("kept_text", "string")] if with_text else [])
    names = [f.name for f in fields] + [n for n, _ in more]
    schema = StructType([*fields, *(StructField(n, {"long": LongType(), "string": StringType()}[t]) for n, t in more)])
    return joined.mapInArrow(tidy(_settle(length, with_text, names)), schema).toDF("doc_id", *plain, *(n for n, _ in more))


def without_repeats(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """The rows with what is left of their texts by ``remove_repeats``, and all their other columns; rows of whose text nothing is left go, those whose text was empty or null stay as they are."""
    names = documents.columns
    plain = [f"c{k}" for k in range(len(names))]
    at, of = plain[names.index(doc_id)], plain[names.index(text)]
    rows = documents.toDF(*plain).withColumn("no_text", F.col(of).isNull())
    left = remove_repeats(rows, of, at, length, (*(c for c in plain if c not in (at, of)), "no_text"), with_text=True).where("n_bytes = 0 OR n_removed < n_bytes")
    own = {at: F.col("doc_id").cast(documents.schema[doc_id].dataType), of: F.when(~F.col("no_text"), F.col("kept_text"))}
    return left.select(*[own.get(c, F.col(c)).alias(n) for n, c in zip(names, plain)])
