"""Phrase counts and scores against plain counting."""

import collections
import random
import re

import pytest

pytest.importorskip("sessionloom.llm.queries")

from sessionloom.llm import collocations  # noqa: E402


def plain(docs, max_words, min_count, cover, top):
    counts, totals = collections.Counter(), collections.Counter()
    for lang, text in docs:
        lang, text = "und" if lang is None else lang, (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            w = re.findall("[^ \t]+", piece)
            totals[lang] += len(w)
            counts.update((lang, tuple(w[i : i + k])) for k in range(1, max_words + 1) for i in range(len(w) - k + 1))
    frequent = {p: f for p, f in counts.items() if len(p[1]) > 1 and f >= min_count}
    rows = collections.defaultdict(list)
    for (lang, p), a in frequent.items():
        if any(g == lang and len(q) > len(p) and 100 * f >= cover * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (g, q), f in frequent.items()):
            continue
        score, _, l, r = min((1000000 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p)))
        rows[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, totals[lang], -s) for lang, own in rows.items() for i, (s, a, p, l, r) in enumerate(sorted(own)[:top]))


def corpus(seed):
    rng = random.Random(seed)
    words = ["the", "The", "new", "york", "café", "ÉCOLE", "\x00nul", "a-b", "日本", "x", '"q"', "nbsp in"]
    docs = [(None, None), ("en", ""), ("en", " \t "), (None, "und, und. und"), ("en", ",.;")]
    for _ in range(60):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "\x0b"]) for _ in range(rng.randrange(1, 60)))
        docs.append((rng.choice(["en", "en", "de", None, ""]), text))
    docs += [("en", "new york city hall again")] * 15 + [("de", "same words " * 2000)]
    return docs


@pytest.mark.parametrize("max_words,min_count,cover,top", [(3, 10, 50, 2000), (4, 3, 90, 40), (2, 2, 50, 5)])
def test_collocations(spark, monkeypatch, max_words, min_count, cover, top):
    monkeypatch.setattr(collocations, "FILTER_BITS", 14)
    docs = corpus(max_words)
    frame = spark.createDataFrame([(i, t, g, "p", 1) for i, (g, t) in enumerate(docs)], "doc_id bigint, text string, lang string, phrase string, f int").repartition(3)
    got = collocations.collocations(frame, max_words, min_count, cover, top)
    assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == plain(docs, max_words, min_count, cover, top)


def test_full_filter_changes_nothing(spark, monkeypatch):
    """Six bits: all phrases pass, and the counts are the same."""
    docs = corpus(9)
    frame = spark.createDataFrame(docs, "lang string, text string")
    want = sorted(map(tuple, collocations.collocations(frame).collect()))
    monkeypatch.setattr(collocations, "FILTER_BITS", 6)
    assert want and sorted(map(tuple, collocations.collocations(frame).collect())) == want


def test_words_whose_hashes_meet(spark, monkeypatch):
    docs = corpus(4)
    monkeypatch.setattr(collocations, "span_hashes", lambda data, start, end, seed=0: (end - start).astype("uint64"))
    import numpy as np
    import pyarrow as pa

    data, offsets = collocations.buffers(pa.array([t for _, t in docs]))
    found = collocations.Phrases(data, offsets, np.zeros(len(docs), np.int64))
    number = found.numbers()
    assert len(set(number.tolist())) == len({found.data[a:b].tobytes() for a, b in zip(found.start, found.end)})


def test_no_rows(spark):
    assert collocations.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None)], "text string, lang string")).count() == 0


def test_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    a, l, r = 3_000_000_019, 3_000_000_037, 3_000_000_077
    wide = {k: F.lit(v).cast("decimal(16,0)") for k, v in (("a", a), ("l", l), ("r", r))}
    got = spark.range(1).select(F.call_function("div", wide["a"] * wide["a"] * F.lit(1_000_000).cast("decimal(7,0)"), wide["l"] * wide["r"])).first()[0]
    assert got == 1_000_000 * a * a // (l * r)
