"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sessionloom.llm.common import Words, mix, steps, text_or_empty, tidy, words


@dataclass(frozen=True)
class FtrlParameters:
    """Weights number 2**bits. train_rows bounds the labelled rows that are learnt from (those with the smallest hash of their id); shards of them are learnt apart and averaged.

    One shard is the default, as each shard learns from its own rows only: by the bound on rows the one task that learns has at most train_rows lists of hashed features, whatever the corpus.
    """

    bits: int = 20
    train_rows: int = 16_000
    shards: int = 1
    epochs: int = 3
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.1


#: Documents that score as much or more are toxic, to the operator's query and to the pipeline.
TOXIC = 0.3

#: What tells single words, pairs and skipping pairs apart.
_KINDS = tuple(np.uint64(k) for k in (0x1B873593CC9E2D51, 0x85EBCA6BC2B2AE35, 0x27D4EB2F165667C5))


def _features(found: Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all texts: the text and the hashed index of each word, pair of neighbours, and pair with one word between."""
    of, h, down = found.of(), found.hash, np.uint64(64 - bits)
    parts = [(of, mix(h ^ _KINDS[0]) >> down)]
    for gap in (1, 2):
        inside = of[:-gap] == of[gap:]
        pair = mix(h[:-gap] * np.uint64(0x9FB21C651E98DF25) + h[gap:] ^ _KINDS[gap])
        parts.append((of[:-gap][inside], pair[inside] >> down))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64)


def _train(examples: list[tuple[np.ndarray, int]], p: FtrlParameters) -> np.ndarray:
    """FTRL-proximal with per-coordinate rates, one example at a time; index 2**bits is the bias, which L1 spares."""
    size = (1 << p.bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    l1 = np.full(size, p.l1)
    l1[-1] = 0

    def weights(zi, ni, li):
        return np.where(np.abs(zi) <= li, 0.0, -(zi - np.sign(zi) * li) / ((p.beta + np.sqrt(ni)) / p.alpha + p.l2))

    for _ in range(p.epochs):
        for at, label in examples:
            zi, ni = z[at], n[at]
            w = weights(zi, ni, l1[at])
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / p.alpha * w
            n[at] = ni + g * g
    return weights(z, n, l1)


def train_toxicity(documents: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", usable: Column | None = None, parameters: FtrlParameters = FtrlParameters()) -> dict[int, float]:
    """Sparse weights (index: weight; index 2**bits is the bias) learnt from labelled documents.

    ``labels`` has doc_id and the label; rows without either are left out, of contradicting ones the larger counts.
    ``usable`` picks the rows of ``labels`` that may be learnt from. At most train_rows ids are used. Their features
    are hashed in Spark tasks; each shard of examples is one FTRL run in one task, and a weight is the mean over the
    shards, kept where most shards keep it. Without usable labels there are no weights: all scores are 0.5.
    """
    p = parameters
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull())
    known = known.where(usable) if usable is not None else known
    known = known.groupBy(F.col(doc_id).alias("label_of")).agg(F.max(label).cast("int").alias("y"))
    sample = known.orderBy(F.xxhash64("label_of"), "label_of").limit(p.train_rows)
    rows = documents.select(F.col(doc_id).alias("label_of"), text_or_empty(text).alias("t")).join(F.broadcast(sample), "label_of")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows_, data, offsets in steps(batch, "t"):
                of, index = _features(words(data, offsets), p.bits)
                both = np.unique((of.astype(np.int64) << p.bits) | index)
                cuts = np.searchsorted(both >> p.bits, np.arange(1, rows_.num_rows))
                sets = [x.astype(np.int32).tobytes() for x in np.split(both & ((1 << p.bits) - 1), cuts)]
                yield pa.RecordBatch.from_arrays([rows_.column("shard"), rows_.column("label_of"), rows_.column("y"), pa.array(sets, pa.binary())], names=["shard", "label_of", "y", "features"])

    def learn(table):
        table = table.sort_by("label_of")
        bias = np.array([1 << p.bits])
        sets = (np.frombuffer(x.as_buffer(), np.int32) for x in table["features"])
        w = _train([(np.concatenate([x, bias]), y) for x, y in zip(sets, table["y"].to_pylist())], p)
        at = np.flatnonzero(w)
        return pa.table({"index": pa.array(at, pa.int64()), "weight": pa.array(w[at], pa.float64())})

    shard = F.pmod(F.xxhash64("label_of", F.lit(7)), F.lit(p.shards)).cast("int")
    features = rows.select(shard.alias("shard"), "label_of", "y", "t").mapInArrow(tidy(hashed), "shard int, label_of long, y int, features binary")
    learnt = features.groupBy("shard").applyInArrow(learn, "index long, weight double")
    mean = learnt.groupBy("index").agg((F.sum("weight") / p.shards).alias("weight"), F.count("*").alias("n"))
    return {r["index"]: r["weight"] for r in mean.where(F.col("n") * 2 >= p.shards).collect()}


def score_toxicity(documents: DataFrame, weights: dict[int, float], text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = (), parameters: FtrlParameters = FtrlParameters(), score: str = "score") -> DataFrame:
    """doc_id, the columns in ``keep``, and ``score``: the probability of label 1, from the whole text alone.

    A feature counts once a text. A null or wordless text gets the bias's probability. Rows keep their number, repeated ones too. A kept column may not have the name of the score.
    Weights are broadcast: at most 2**bits + 1 of them, 12 bytes each.
    """
    bits = parameters.bits
    names = ["doc_id"] + [c for c in keep if c != "doc_id"]
    if score in names:
        raise ValueError(f"{score} is a kept column; give the score another name")
    at = np.array(sorted(weights), np.int64)
    shipped = documents.sparkSession.sparkContext.broadcast((at, np.array([weights[i] for i in at], np.float64)))
    inner = [f"c{k}" for k in range(len(names))]
    rows = documents.select(*[F.col(doc_id if n == "doc_id" else n).alias(c) for n, c in zip(names, inner)], text_or_empty(text).alias("score_text"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w = shipped.value
        table = np.zeros((1 << bits) + 1)
        table[at] = w
        used = table != 0
        for batch in batches:
            for rows, data, offsets in steps(batch, "score_text"):
                of, index = _features(words(data, offsets), bits)
                hit = used[index]
                both = np.unique((of[hit].astype(np.int64) << bits) | index[hit])
                total = np.bincount(both >> bits, table[both & ((1 << bits) - 1)], rows.num_rows) + table[-1]
                yield rows.select(inner).append_column("score", pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35)))))

    schema = StructType([*rows.schema.fields[:-1], StructField("score", DoubleType())])
    return rows.mapInArrow(tidy(scored), schema).toDF(*names, score)


def reject_toxic(documents: DataFrame, weights: dict[int, float], threshold: float = TOXIC, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows that score below the threshold, with all their columns. Where nothing was learnt (no weights), nothing is known of any document and all stay."""
    if not weights:
        return documents
    score = "toxicity"
    while score in documents.columns:
        score += "_"
    return score_toxicity(documents, weights, text, doc_id, tuple(documents.columns), score=score).where(F.col(score) < threshold).select(*documents.columns)
