"""Benchmark decontamination by a broadcast hash set of the items' word windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from sessionloom.llm.common import buffers, ngrams, steps, text_or_empty, tidy, words

#: Bytes of item text whose windows are broadcast at once (some 100 times that in memory); more items make further passes.
BROADCAST_BYTES = 2 << 20


class ItemWindows:
    """The windows of some benchmark items: for each window length sorted hashes, and the items and words of each."""

    def __init__(self, ids: list[int | None], texts: list[str | None], window: int):
        data, offsets = buffers(pa.array(texts, pa.large_string()))
        found = words(data, offsets)
        self.by_length: dict[int, tuple[np.ndarray, list[list[tuple[bytes, list[int]]]]]] = {}
        gathered: dict[int, dict[int, dict[bytes, set[int]]]] = {}
        for k, item in enumerate(ids):
            a, b = found.first[k], found.first[k + 1]
            if a == b:
                continue
            n = min(window, b - a)
            for i, h in enumerate(ngrams(found.hash[a:b], n).tolist()):
                shape = b" ".join(found.folded[s:e].tobytes() for s, e in zip(found.start[a + i : a + i + n], found.end[a + i : a + i + n]))
                gathered.setdefault(int(n), {}).setdefault(h, {}).setdefault(shape, set()).update(() if item is None else (item,))
        for n, by_hash in gathered.items():
            keys = sorted(by_hash)
            self.by_length[n] = (np.array(keys, np.uint64), [[(shape, sorted(items)) for shape, items in by_hash[h].items()] for h in keys])


def _scan(shipped):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: ItemWindows = shipped.value
        for batch in batches:
            for rows, data, offsets in steps(batch, "dc_text"):
                found = words(data, offsets)
                of, total = found.of(), len(found.hash)
                marks = np.zeros(total + 1, np.int64)
                hits: dict[int, set[int]] = {}
                for n, (keys, shapes) in windows.by_length.items():
                    if total < n:
                        continue
                    grams = ngrams(found.hash, n)
                    slot = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
                    for i in np.flatnonzero((keys[slot] == grams) & (of[: total - n + 1] == of[n - 1 :])).tolist():
                        shape = b" ".join(found.folded[s:e].tobytes() for s, e in zip(found.start[i : i + n], found.end[i : i + n]))
                        for known, items in shapes[slot[i]]:
                            if known == shape:
                                marks[i] += 1
                                marks[i + n] -= 1
                                hits.setdefault(int(of[i]), set()).update(items)
                hit = np.cumsum(marks[:-1]) > 0
                spans = [list(x or ()) for x in rows.column("dc_spans").to_pylist()] if hits else None
                items = [list(x or ()) for x in rows.column("dc_items").to_pylist()] if hits else None
                for k in hits:
                    a, b = int(found.first[k]), int(found.first[k + 1])
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit[a:b], [False]]).astype(np.int8))).reshape(-1, 2)
                    spans[k] = _union(spans[k], [(x, y, int(found.start[a + x] - offsets[k]), int(found.end[a + y - 1] - offsets[k])) for x, y in edge.tolist()])
                    items[k] = sorted({*items[k], *hits[k]})
                columns = {name: rows.column(name) for name in rows.schema.names}
                columns["dc_words"] = pa.array(np.diff(found.first), pa.int64())
                if hits:
                    columns["dc_spans"] = pa.array([[dict(zip(("from_word", "to_word", "from_byte", "to_byte"), s)) for s in map(_four, x)] or None for x in spans], SPANS)
                    columns["dc_items"] = pa.array([x or None for x in items], rows.schema.field("dc_items").type)
                yield pa.RecordBatch.from_arrays([columns[n] for n in rows.schema.names], names=rows.schema.names)

    return scan


SPANS = pa.list_(pa.struct([(n, pa.int64()) for n in ("from_word", "to_word", "from_byte", "to_byte")]))
_SPANS_SQL = "array<struct<from_word: bigint, to_word: bigint, from_byte: bigint, to_byte: bigint>>"


def _four(span) -> tuple[int, int, int, int]:
    return tuple(span.values()) if isinstance(span, dict) else span


def _union(old: list, new: list) -> list:
    """Word spans of both, overlapping and touching ones joined."""
    out: list[tuple[int, int, int, int]] = []
    for span in sorted([*map(_four, old), *new]):
        if out and span[0] <= out[-1][1]:
            last = out[-1]
            out[-1] = (last[0], max(last[1], span[1]), last[2], max(last[3], span[3]))
        else:
            out.append(span)
    return out


def _also(found: DataFrame | None, rows: DataFrame, shipped, schema) -> DataFrame:
    """Hits of one more pass, once a text, added to those found."""
    texts = rows.mapInArrow(tidy(_scan(shipped)), schema).where("dc_spans IS NOT NULL")
    hits = texts.select(F.sha2("dc_text", 256).alias("dc_key"), F.col("dc_spans").alias("more_spans"), F.col("dc_items").alias("more_items")).dropDuplicates(["dc_key"])
    return hits if found is None else found.unionAll(hits)


def _with_later(rows: DataFrame, later: DataFrame) -> DataFrame:
    """Rows of the first pass with the hits of the other passes, joined by the digest of the text."""
    more = later.groupBy("dc_key").agg(F.flatten(F.collect_list("more_spans")).alias("more_spans"), F.flatten(F.collect_list("more_items")).alias("more_items"))
    joined = rows.withColumn("dc_key", F.sha2("dc_text", 256)).join(more, "dc_key", "left").drop("dc_key")
    names = rows.columns

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(n) for n in names}
            at = [k for k, x in enumerate(batch.column("more_spans")) if x.is_valid]
            if at:
                spans, items = (batch.column(n).to_pylist() for n in ("dc_spans", "dc_items"))
                new_spans, new_items = (batch.column(n).to_pylist() for n in ("more_spans", "more_items"))
                for k in at:
                    spans[k] = [dict(zip(("from_word", "to_word", "from_byte", "to_byte"), s)) for s in _union(spans[k] or [], list(map(_four, new_spans[k])))]
                    items[k] = sorted({*(items[k] or []), *new_items[k]})
                columns |= {"dc_spans": pa.array(spans, SPANS), "dc_items": pa.array(items, batch.schema.field("dc_items").type)}
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return joined.mapInArrow(tidy(merge), rows.schema)


def decontaminate(documents: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, remove: str | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Find benchmark windows in whole documents and, if asked, take them out.

    Words are runs of 0-9, a-z (A-Z lower-cased) and non-ASCII characters. A window is ``window`` consecutive words
    of an item; an item of fewer words, but not none, is one window. Window hashes are broadcast, each hit is verified
    on the words themselves. Items whose text exceeds ``broadcast_bytes`` together are scanned for in several passes,
    each in tasks of its own with a broadcast below that bound (a longer single item makes a pass alone); their hits meet by the text's digest.

    Item ids that are whole numbers stay so; others are strings. An item without an id hits as any other and is in no list of ids.

    Returns the columns of ``documents`` and dc_words, dc_hit_words, dc_items (item ids that occur, ascending),
    dc_spans (hit word runs, with their bytes), dc_contaminated. ``remove='spans'`` also cuts the bytes of hit runs from
    the text, ``remove='documents'`` drops contaminated rows. Null texts have no words; repeated rows are judged
    alike; an empty benchmark hits nothing. Columns named dc_* in the input are replaced.
    """
    spark = documents.sparkSession
    kind = "bigint" if isinstance(benchmark.schema[item_id].dataType, IntegralType) else "string"
    spans_of = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_id).cast(kind).alias("id"), F.col(item_text).cast("string").alias("t"))
    rows = documents.withColumns({"dc_text": text_or_empty(text), "dc_words": F.lit(None).cast("long"), "dc_spans": F.lit(None).cast(_SPANS_SQL), "dc_items": F.lit(None).cast(f"array<{kind}>")})
    schema = rows.schema
    ids, texts, size, later = [], [], 0, None

    def windows():
        return spark.sparkContext.broadcast(ItemWindows(ids, texts, window))

    # the iterator holds one partition at a time; a pass is cut at the bound
    scanned = None
    for r in spans_of.orderBy("id", "t").toLocalIterator():
        if ids and size + len(r["t"]) * 2 > broadcast_bytes:
            if scanned is None:
                scanned = rows.mapInArrow(tidy(_scan(windows())), schema)
            else:
                later = _also(later, rows, windows(), schema)
            ids, texts, size = [], [], 0
        ids.append(r["id"])
        texts.append(r["t"])
        size += len(r["t"]) * 2
    if scanned is None:
        rows = rows.mapInArrow(tidy(_scan(windows())), schema)
    else:
        rows = _with_later(scanned, _also(later, rows, windows(), schema))
    spans = F.coalesce("dc_spans", F.array().cast(_SPANS_SQL))
    out = rows.withColumns(
        {"dc_spans": spans, "dc_items": F.coalesce("dc_items", F.array().cast(f"array<{kind}>")), "dc_hit_words": F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["to_word"] - s["from_word"]), "dc_contaminated": F.size(spans) > 0}
    )
    if remove == "documents":
        out = out.where("NOT dc_contaminated")
    elif remove == "spans":
        raw = F.encode("dc_text", "UTF-8")
        cuts = F.concat(F.transform("dc_spans", lambda s: s["from_byte"]), F.array(F.octet_length("dc_text").cast("long")))
        starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("dc_spans", lambda s: s["to_byte"]))
        kept = F.array_join(F.transform(F.arrays_zip(starts.alias("a"), cuts.alias("b")), lambda p: F.decode(F.substring(raw, (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int")), "UTF-8")), "")
        out = out.withColumn(text, F.when(F.col("dc_contaminated"), kept).otherwise(F.col(text)))
    return out.drop("dc_text")


def clean_documents(documents: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows in which no window of a benchmark item occurs (see ``decontaminate``), with all their columns, whatever they are called."""
    names = documents.columns
    plain = [f"c{k}" for k in range(len(names))]
    return decontaminate(documents.toDF(*plain), benchmark, plain[names.index(text)], remove="documents").select(*[F.col(c).alias(n) for n, c in zip(names, plain)])


def items_digest(items: list[int]) -> str:
    """Hexadecimal SHA-256 of the ids, sorted as strings and joined by commas; ``decontamination_report`` does the same in Spark."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
