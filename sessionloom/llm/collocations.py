"""Collocations of a corpus by level-wise counting of phrases."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionloom.llm.common import buffers, fresh_dir, mix, same_spans, span_hashes, steps, text_or_empty, tidy

#: Bits of the broadcast filter of frequent phrases, as a power of two: 16 MB, whatever the corpus.
FILTER_BITS = 27
#: Bytes of text that are counted at once.
STEP = 1 << 20
#: Parts in which a language's phrases are ranked before they meet.
DEALT = 64
#: Lower-cased bytes, and what a byte is: of a word (0), a gap between words (1), an end of a piece (2).
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2


class Phrases:
    """Words of some texts with exact numbers, and the phrases that start at each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, group: np.ndarray):
        """``group`` numbers each text's language; ``seed`` of a group enters the hashes."""
        self.data = _LOWER[data]
        kind = _KIND[data]
        inside = kind == 0
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        texts = np.searchsorted(offsets, self.start, side="right") - 1
        self.group = group[texts]
        pieces = np.cumsum(kind == 2, dtype=np.int32)[self.start] if len(self.start) else np.zeros(0, np.int32)
        #: whether a word and the next are neighbours in one piece
        self.joined = (pieces[1:] == pieces[:-1]) & (texts[1:] == texts[:-1])

    def hashes(self, seeds: np.ndarray, k: int) -> np.ndarray:
        """Hashes of the k words from each word on, whether neighbours or not."""
        words = mix(span_hashes(self.data, self.start, self.end) ^ seeds[self.group])
        out = words[: max(0, len(words) - k + 1)].copy()
        for j in range(1, k):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) ^ words[j : len(words) - k + 1 + j])
        return out

    def numbers(self) -> np.ndarray:
        """A number for each word, equal for equal words of a group: by hash, and checked on bytes."""
        hashed = mix(span_hashes(self.data, self.start, self.end) + self.group.astype(np.uint64))
        number, _ = pd.factorize(hashed)
        first = _first(number)[number]
        if len(number) and not (same_spans(self.data, self.start, self.end, self.data, self.start[first], self.end[first]) & (self.group == self.group[first])).all():
            seen: dict = {}
            number = np.array([seen.setdefault((g, self.data[a:b].tobytes()), len(seen)) for g, a, b in zip(self.group.tolist(), self.start.tolist(), self.end.tolist())])
        return number.astype(np.int64)

    def texts(self, at: np.ndarray, k: int) -> pa.Array:
        """The k words from each of these on, joined by spaces."""
        start, size = np.stack([self.start[at + j] for j in range(k)], 1).reshape(-1), np.stack([self.end[at + j] - self.start[at + j] for j in range(k)], 1)
        size[:, :-1] += 1  # a place for the space
        flat = size.reshape(-1)
        to = np.cumsum(flat) - flat
        total = int(flat.sum())
        source = np.arange(total) + np.repeat(start - to, flat)
        out = self.data[np.minimum(source, max(0, len(self.data) - 1))] if total else np.zeros(0, np.uint8)
        spaces = (to + flat - 1).reshape(-1, k)[:, :-1].reshape(-1)
        out[spaces] = 0x20
        offsets = np.r_[0, np.cumsum(size.sum(1))].astype(np.int32)
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(out))


def _first(number: np.ndarray) -> np.ndarray:
    first = np.zeros(int(number.max()) + 1 if len(number) else 0, np.int64)
    first[number[::-1]] = np.arange(len(number) - 1, -1, -1)
    return first


def _seeds(names: pa.Array) -> np.ndarray:
    data, offsets = buffers(names)
    return span_hashes(data, offsets[:-1], offsets[1:], 1)


def _languages(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    coded = column.dictionary_encode()
    return coded.dictionary.cast(pa.string()), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _slots(hashed: np.ndarray, filter_bits: int) -> tuple[np.ndarray, np.ndarray]:
    place = (hashed >> np.uint64(64 - filter_bits)).astype(np.int64)
    return place >> 6, place & 63


def _counter(k: int, shipped):
    """Counts phrases of k words whose first and last k - 1 words are both in the shipped filter; at the first level, all words, and under a null phrase their sum."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value if shipped is not None else None
        for batch in batches:
            for part, data, offsets in steps(batch, "text", STEP):
                names, group = _languages(part.column("lang"))
                found = Phrases(data, offsets, group)
                n = len(found.start)
                number = found.numbers()
                width = int(number.max()) + 1 if n else 1
                if k == 1:
                    at = np.arange(n)
                else:
                    slot, bit = _slots(found.hashes(_seeds(names), k - 1), int(len(known)).bit_length() + 5)
                    frequent = (known[slot] >> bit.astype(np.uint64)) & np.uint64(1) == 1
                    together = np.ones(max(0, n - k + 1), bool)
                    for j in range(k - 1):
                        together &= found.joined[j : n - k + 1 + j]
                    at = np.flatnonzero(together & frequent[: len(together)] & frequent[1 : len(together) + 1])
                code = number[at]
                for j in range(1, k):
                    code = pd.factorize(code * width + number[at + j])[0].astype(np.int64)
                if k == 1:
                    code = pd.factorize(code)[0]
                first = at[_first(code)]
                counts = np.bincount(code, minlength=len(first))
                langs, phrases = names.take(pa.array(found.group[first])), found.texts(first, k)
                if k == 1:
                    totals = np.bincount(found.group, minlength=len(names))
                    langs, phrases, counts = pa.concat_arrays([langs, names]), pa.concat_arrays([phrases, pa.nulls(len(names), pa.string())]), np.r_[counts, totals]
                yield pa.RecordBatch.from_arrays([langs, phrases, pa.array(counts.astype(np.int64))], names=["lang", "phrase", "f"])

    return tidy(count)


def _filter(level: DataFrame, k: int, filter_bits: int) -> np.ndarray:
    """A bitmap of the hashes of a level's phrases, put together in Spark; a false hit costs a phrase that the count then drops."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, group = _languages(batch.column("lang"))
            data, offsets = buffers(batch.column("phrase"))
            found = Phrases(data, offsets, group)
            hashed = found.hashes(_seeds(names), k)
            slot, bit = _slots(hashed[np.searchsorted(found.start, offsets[:-1])], filter_bits)
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array((np.uint64(1) << bit.astype(np.uint64)).view(np.int64))], names=["slot", "bits"])

    rows = level.where(F.col("phrase").isNotNull()).select("lang", "phrase").mapInArrow(bits, "slot int, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (filter_bits - 6), np.uint64)
    out[rows.column("slot").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def level_tables(df: DataFrame, max_words: int = 3, min_count: int = 10, text: str = "text", lang: str = "lang") -> list[DataFrame]:
    """Counts (lang, phrase, f) of all phrases of 1, 2, ... words with f >= min_count; the first table also has all words' number under a null phrase.

    Level k is a pass over the texts: a phrase is emitted only if its first and its last k - 1 words are in the filter of the level before; what a task
    has counted of 1 MB of text at a time is summed by phrase before and after the exchange. The filter is a bitmap of fixed size, built in
    Spark and broadcast; how full it is changes the work, never the counts. Each table is written to the shared folder.
    """
    spark = df.sparkSession
    rows = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), text_or_empty(text).alias("text"))
    out: list[DataFrame] = []
    for k in range(1, max_words + 1):
        shipped = spark.sparkContext.broadcast(_filter(out[-1], k - 1, FILTER_BITS)) if out else None
        counted = rows.mapInArrow(_counter(k, shipped), "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        path = fresh_dir(spark, f"level{k}")
        # few of the counted phrases stay, and as few files
        counted.where((F.col("f") >= min_count) | F.col("phrase").isNull()).hint("rebalance").write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def _words(k_from: Column, k_to: Column) -> Column:
    """Words of phrase number k_from (from 1) up to before k_to, joined."""
    return F.array_join(F.slice(F.split("phrase", " "), k_from, k_to - k_from), " ")


def collocations(df: DataFrame, max_words: int = 3, min_count: int = 10, cover: int = 50, top: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """Each language's best phrases of 2 to max_words words: lang, rank, phrase, a, l, r, n, score.

    Texts have A-Z lower-cased, are split at ``.,;:!?`` and line ends into pieces, and those at blanks and tabs into words. A candidate occurs at least ``min_count`` times (a); a cut after k words has the
    counts l and r of both sides and the score floor(10^6 a a / (l r)), in decimals of 38 digits, and the lowest-scoring cut counts (ties: smallest k). A candidate inside a longer one with at least ``cover`` percent of
    its occurrences is dropped. The ``top`` of each language stay, by score and a descending, then phrase (its bytes).

    A null text is empty, a null lang is ``und``; repeated rows count each; other columns are left out; an empty table gives no rows. Not lazy: the levels are counted at once.
    """
    levels = level_tables(df, max_words, min_count, text, lang)
    counts = levels[0]
    total = counts.where(F.col("phrase").isNull()).select("lang", F.col("f").alias("n"))
    counts = counts.where(F.col("phrase").isNotNull())
    for level in levels[1:-1]:
        counts = counts.unionByName(level)
    candidates = None
    for k, level in enumerate(levels[1:], 2):
        rows = level.select("lang", "phrase", F.col("f").alias("a"), F.lit(k).alias("k"))
        candidates = rows if candidates is None else candidates.unionByName(rows)
    k, j = F.col("k"), F.col("j")
    cuts = candidates.withColumn("j", F.explode(F.sequence(F.lit(1), k - 1)))
    cuts = cuts.withColumns({"left": _words(F.lit(1), j + 1), "right": _words(j + 1, k + 1)})
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    wide = {c: F.col(c).cast("decimal(16,0)") for c in "alr"}
    score = F.call_function("div", wide["a"] * wide["a"] * F.lit(1_000_000).cast("decimal(7,0)"), wide["l"] * wide["r"])
    scored = cuts.groupBy("lang", "phrase", "a", "k").agg(F.min(F.struct(score.alias("score"), "j", "l", "r")).alias("best"))
    # candidates inside longer ones: from each candidate, all shorter runs of its words
    at = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), k - 1), lambda n: F.transform(F.sequence(F.lit(1), k - n + 1), lambda i: F.struct(i.alias("i"), n.alias("n"))))))
    inside = candidates.where(k > 2).withColumn("at", at).select("lang", _words(F.col("at.i"), F.col("at.i") + F.col("at.n")).alias("phrase"), F.col("a").alias("longer"))
    covered = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(covered, ["lang", "phrase"], "left").where(~F.coalesce(100 * F.col("longer") >= cover * F.col("a"), F.lit(False)))
    order = [F.desc("best.score"), F.desc("a"), F.col("phrase")]
    # the best of each of DEALT parts of a language, then the best of those
    part = F.pmod(F.xxhash64("phrase"), F.lit(DEALT))
    near = kept.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    # one row a language
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "best.l", "best.r", "n", "best.score")
