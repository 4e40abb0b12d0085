"""The training-data operators against plain versions, round trips and held-out accuracy."""

import itertools
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("sessionloom.llm.queries")

from sessionloom.llm import decontamination, id_coder, jaccard, nearest, packing, queries, repeats, sharding, suffix_arrays, token_files, tokens, toxicity, url_filters, warc  # noqa: E402
from tests.llm import brute  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, host string"
DATA = "/root/testdata/sf0.001"


def table(spark, docs):
    """Documents with columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, "en", "src0", len(t or ""), 9.0, "h") for i, t in docs], SCHEMA)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdéß") for _ in range(rng.randrange(2, 7))) for _ in range(80)]
    passages = [" ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(4)]
    docs = [(0, None), (1, ""), (2, "   "), (3, "one two"), (4, "One  TWO!")]
    for i in range(5, n):
        kind = i % 6
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(8, 120)))
        if kind == 1 and i > 12:
            text = docs[rng.randrange(6, i)][1]
        elif kind == 2 and i > 12:
            old = docs[rng.randrange(6, i)][1].split()
            for _ in range(max(1, len(old) // 100)):
                old[rng.randrange(len(old))] = "changed"
            text = " ".join(old)
        elif kind == 3:
            text += "\n" + rng.choice(passages) + "\n" + text[:40]
        elif kind == 4:
            text = "again and " * rng.randrange(1, 60) + text
        docs.append((i, text))
    docs.append((n, " ".join(rng.choice(vocabulary) for _ in range(9000))))
    return docs


@pytest.fixture(scope="module")
def docs():
    return corpus()


@pytest.fixture(scope="module")
def frame(spark, docs):
    return table(spark, docs).repartition(3, "doc_id").cache()


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(queries.tokenizer_path())


# --- 1 ------------------------------------------------------------------------------------------------------------

URLS = [None, "", "no scheme", "http://", "http://com", "http://com/", "HTTP://Foo.EXAMPLE.com/en/x?y#z", "https://www.example.com/en/", "https://a.www.example.com/en/b/c", "ftp://x.net/es/1", "http://x.net/es", "http://net/fr/?q", "http://notexample.com/en/1", "http://example.com#/en/", "http://a.b.c.d.e.example.com/en/" + "p/" * 3000]


def test_url_filter(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(3, URLS[6]), (3, URLS[6])]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in rows], "page_id bigint, url string, host string, rule string")
    for extra in ([], [("example.com/en/foo", "flag"), ("b.c.d.e.example.com/en/p/p/", "flag"), ("", "root"), ("www.example.com/en/", "block")]):
        rules = [*queries.URL_RULES, *extra]
        got = url_filters.url_filter(pages, spark.createDataFrame(rules, "rule string, verdict string")).collect()
        want = sorted((i, *brute.judge(u, [r for r in rules if r[0] or True])) for i, u in rows)
        if not extra:
            assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
        else:
            # the longest of the rules that fit, over all hosts
            assert {(r["page_id"], r["rule"]) for r in got} == {(w[0], w[3]) for w in want}
        assert len(got) == len(rows)
    assert url_filters.url_filter(pages.limit(0), spark.createDataFrame(list(queries.URL_RULES), "rule string, verdict string")).count() == 0


def test_url_filter_by_shuffle(spark, monkeypatch):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id bigint, url string")
    rules = spark.createDataFrame(list(queries.URL_RULES), "rule string, verdict string")
    want = sorted(map(str, url_filters.url_filter(pages, rules).collect()))
    monkeypatch.setattr(url_filters, "MAX_BROADCAST_RULES", 0)
    assert sorted(map(str, url_filters.url_filter(pages, rules).collect())) == want


# --- 2 ------------------------------------------------------------------------------------------------------------


def test_shards(spark):
    rng = random.Random(3)
    docs = [(i, "x" * rng.randrange(0, 400)) for i in range(300)] + [(i, "hot" * 30) for i in range(300, 500)] + [(None, "n"), (7, None)] + [(5, "again" * 20)] * 150 + [(900, "long" * 200), (901, "")]
    got = sharding.histogram_shards(table(spark, docs).repartition(3), 8).toPandas()
    assert len(got) == len(docs) and set(got["shard"]) == set(range(8))
    size = got.groupby("shard")["size"].sum()
    assert size.max() - size.min() <= 2 * 808
    for _, slots in got.groupby("shard")["slot"]:
        assert sorted(slots) == list(range(len(slots)))
    want = sorted((zlib.crc32((t or "").encode()), len((t or "").encode()) + 8) for _, t in docs)
    assert sorted(zip(got["text_crc32"], got["size"])) == want
    ordered = got.sort_values(["shard", "slot"])
    key = list(zip(ordered["text_crc32"], ordered["doc_id"].fillna(-1)))
    assert key == sorted(key)
    assert sharding.histogram_shards(table(spark, []), 8).count() == 0


def test_shards_against_a_plain_sort(spark):
    rng = random.Random(4)
    docs = [(i, "".join(rng.choices("abc ", k=rng.randrange(0, 30)))) for i in range(400)] + [(3, "same")] * 60
    got = sharding.histogram_shards(table(spark, docs).repartition(2), 5, tolerance=0).toPandas()
    rows = sorted((zlib.crc32(t.encode()), i, len(t.encode()) + 8) for i, t in docs)
    total, at, want = sum(r[2] for r in rows), 0, []
    for crc, i, size in rows:
        # a boundary lies on the side of a row that is nearer to its target
        want.append((crc, i, sum(1 for k in range(1, 5) if at + size / 2 > total * k / 5 or (at + size / 2 == total * k / 5 and size == 0))))
        at += size
    assert sorted(zip(got["text_crc32"], got["doc_id"], got["shard"])) == sorted(want)


def test_shards_of_one_repeated_row(spark):
    got = sharding.histogram_shards(table(spark, [(None, "x")] * 40), 4).toPandas()
    assert got.groupby("shard").size().tolist() == [10] * 4


# --- 3 ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 127, 129, 5000, 600_000])
@pytest.mark.parametrize("most", [1, 300, 49408])
def test_coder(n, most):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n), most).astype(np.uint32) - 1
    block = id_coder.encode_block(ids, 49408)
    assert (id_coder.decode_block(block[: id_coder.HEAD_BYTES], block[id_coder.HEAD_BYTES :]) == ids).all()
    damaged = bytearray(block)
    damaged[-1] ^= 1
    with pytest.raises(ValueError):
        id_coder.decode_block(bytes(damaged[: id_coder.HEAD_BYTES]), bytes(damaged[id_coder.HEAD_BYTES :]))


def test_coder_uses_context():
    phrase = np.random.default_rng(0).integers(0, 5000, 500).astype(np.uint32)
    assert len(id_coder.encode_block(np.tile(phrase, 400), 49408)) < 200_000 * 0.6


def test_coder_of_a_source_with_four_followers():
    rng = np.random.default_rng(1)
    n, follow, choice = 1 << 20, rng.integers(0, 1000, (1000, 4)), None
    choice = rng.choice(4, n, p=[0.4, 0.3, 0.2, 0.1])
    ids = np.zeros(n, np.uint32)
    for k in range(1, n):
        ids[k] = follow[ids[k - 1], choice[k]]
    # 1.85 bits an id, once the followers are known
    assert 8 * len(id_coder.encode_block(ids, 1000)) < 1.15 * 1.85 * n



def test_coder_goes_a_step_an_id(monkeypatch):
    ids = np.random.default_rng(3).zipf(1.3, 40_000).clip(1, 49408).astype(np.uint32) - 1
    block, steps, layout = id_coder.encode_block(ids, 49408), [], id_coder.Model.layout
    monkeypatch.setattr(id_coder.Model, "layout", lambda self, last, run: steps.append(len(last)) or layout(self, last, run))
    assert (id_coder.decode_block(block[: id_coder.HEAD_BYTES], block[id_coder.HEAD_BYTES :]) == ids).all()
    assert sum(steps) == len(ids)


@pytest.mark.parametrize("n", [70_000, 2_200_000])
def test_coder_of_many_symbols(n):
    ids = np.concatenate([np.random.default_rng(n).permutation(n), np.arange(1000), np.arange(1000)]).astype(np.uint32)
    block = id_coder.encode_block(ids, n)
    assert (id_coder.decode_block(block[: id_coder.HEAD_BYTES], block[id_coder.HEAD_BYTES :]) == ids).all()


def test_blocks_are_even(monkeypatch, tmp_path):
    sizes, encode = [], token_files.encode_block
    monkeypatch.setattr(token_files, "BLOCK_IDS", 1000)
    monkeypatch.setattr(token_files, "encode_block", lambda ids, symbols: sizes.append(len(ids)) or encode(ids, symbols))
    for n, want in ((0, []), (1, [1]), (1250, [1250]), (1251, [625, 626]), (4100, [1025] * 4)):
        sizes.clear()
        ids = np.arange(n, dtype=np.uint32) % 7
        (tmp_path / "x.ids").write_bytes(token_files.FILE_MAGIC + token_files.encode_segment(np.array([5]), np.array([n]), ids))
        assert sizes == want
        assert [(d.tolist(), m.tolist(), i.tolist()) for d, m, i in token_files.read_segments(str(tmp_path / "x.ids"))] == [([5], [n], ids.tolist())]


ODD = ["don't stop", "a<|endoftext|>b", "x y z", "é ́a", "\x00\x1c\x85", "ÀÖØßÿ ²³¹ ªºµ", "12'3 '' 've", "ΣΑΣ İ", "日本語 テスト", "a\r\nb\tc\x0bd\x0ce", "👍🏽 flag", "'", "<|startoftext|>"]


def test_encoder(tokenizer, docs):
    import pyarrow as pa

    from sessionloom.llm.common import buffers

    texts = ODD + [t for _, t in docs if t]
    ids, ends = tokens.encoder(queries.tokenizer_path()).encode(*buffers(pa.array(texts, pa.large_string())))
    for k, t in enumerate(texts):
        assert ids[ends[k] : ends[k + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t
    other = tokens.encoder(queries.tokenizer_path("byte_bpe_50k.json"))
    ids, ends = other.encode(*buffers(pa.array(texts, pa.large_string())))
    assert not other.by_part and ids[: ends[1]].tolist() == other.tokenizer.encode(texts[0], add_special_tokens=False).ids


def test_encoder_of_parts_with_equal_polynomials(tokenizer):
    import pyarrow as pa

    from sessionloom.llm.common import buffers

    texts = [thue_morse(*pair, n) for n in (1024, 2048, 5000) for pair in ("ac", "ca")]
    ids, ends = tokens.TextEncoder(queries.tokenizer_path()).encode(*buffers(pa.array(texts, pa.large_string())))
    for k, t in enumerate(texts):
        assert ids[ends[k] : ends[k + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_encoder_of_parts_with_equal_hashes(tokenizer, docs, monkeypatch):
    import pyarrow as pa

    from sessionloom.llm.common import buffers

    monkeypatch.setattr(tokens, "span_hashes", lambda data, start, end: (end - start).astype(np.uint64) << np.uint64(20))
    texts = ODD + [t for _, t in docs if t]
    encoder = tokens.TextEncoder(queries.tokenizer_path())
    for _ in range(2):
        ids, ends = encoder.encode(*buffers(pa.array(texts, pa.large_string())))
        for k, t in enumerate(texts):
            assert ids[ends[k] : ends[k + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_token_files(spark, frame, docs, tokenizer):
    got = {r["doc_id"]: tuple(r)[1:] for r in token_files.token_round_trip(frame, queries.tokenizer_path()).collect()}
    at = 0
    for i, t in sorted(docs):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        assert got[i] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_files.token_round_trip(table(spark, []), queries.tokenizer_path()).count() == 0
    twice = token_files.token_round_trip(table(spark, [(None, "a"), (5, "b"), (5, "b")]), queries.tokenizer_path()).orderBy("start").collect()
    assert [r["doc_id"] for r in twice] == [None, 5, 5]


# --- 4 ------------------------------------------------------------------------------------------------------------


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test data")
def test_toxicity_held_out(spark):
    rows = queries.op4_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").toPandas()
    rank, toxic = rows["score"].rank(), rows["toxic"] == 1
    area = (rank[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert area > 0.95 and rows[rows["predicted"] == 1]["toxic"].mean() > 0.9


def test_training_against_a_plain_version():
    rng = random.Random(6)
    parameters = toxicity.FtrlParameters(bits=8, epochs=2, l1=0.5)
    examples = [(sorted(rng.sample(range(256), rng.randrange(1, 20))) + [256], rng.randrange(2)) for _ in range(200)]
    z, n = [0.0] * 257, [0.0] * 257

    def weight(i):
        l1 = 0.0 if i == 256 else parameters.l1
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - (l1 if z[i] > 0 else -l1)) / ((parameters.beta + n[i] ** 0.5) / parameters.alpha + parameters.l2)

    for _ in range(parameters.epochs):
        for at, y in examples:
            w = {i: weight(i) for i in at}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            for i in at:
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / parameters.alpha * w[i]
                n[i] += g * g
    got = toxicity._train([(np.array(at), y) for at, y in examples], parameters)
    assert np.allclose(got, [weight(i) for i in range(257)], atol=1e-9) and (got == 0).any()


def test_toxicity_small(spark):
    docs = [(i, ("nasty " if i % 3 == 0 else "fine ") + f"w{i % 7} text here") for i in range(120)] + [(200, None), (201, "")]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(100)] + [(None, 1), (3, None), (999, 1)], "doc_id bigint, toxic int")
    weights = toxicity.train_toxicity(table(spark, docs), labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(table(spark, docs), weights).collect()}
    assert min(got[i] for i in range(0, 120, 3)) > max(got[i] for i in range(1, 120, 3)) and 0 <= got[200] == got[201] <= 1
    assert toxicity.score_toxicity(table(spark, docs), toxicity.train_toxicity(table(spark, docs), labels.limit(0))).where("score = 0.5").count() == len(docs)
    # neither label nor other columns are inputs: the same text has the same score
    again = toxicity.score_toxicity(table(spark, [(7, docs[0][1])]), weights).first()["score"]
    assert again == got[0]
    # repeated rows and very long texts are scored as they are; a column of the score's name stays
    long = docs[0][1] + " fine" * 200_000
    rows = table(spark, [(7, docs[0][1]), (7, docs[0][1]), (8, long), (None, "nasty nasty")])
    twice = toxicity.score_toxicity(rows, weights, keep=("host",), score="s").collect()
    assert len(twice) == 4 and twice[0]["s"] == twice[1]["s"] == again and {r["host"] for r in twice} == {"h"}
    left = toxicity.reject_toxic(rows, weights, threshold=0.5)
    assert left.columns == rows.columns and left.where("doc_id = 7").isEmpty() and left.where("score = 9.0").count() == left.count()
    with pytest.raises(ValueError):
        toxicity.score_toxicity(rows, weights, keep=("score",))


# --- 5 ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 9, 300, 3000])
def test_suffix_array(n):
    rng = np.random.default_rng(n)
    text = rng.integers(97, 99, n).astype(np.uint8)
    text[n // 2 : n // 2 + n // 4] = text[: n // 4]
    raw, array = text.tobytes(), suffix_arrays.suffix_array(text, 100)
    assert sorted(array) == list(range(n)) and all(raw[a : a + 100] <= raw[b : b + 100] for a, b in zip(array, array[1:]))
    shared = suffix_arrays.common_prefixes(text, array, 100)
    for k in range(1, n):
        a, b, m = array[k - 1], array[k], 0
        while m < 100 and max(a, b) + m < n and raw[a + m] == raw[b + m]:
            m += 1
        assert min(shared[k], 100) == m


def check_repeats(spark, docs):
    got = repeats.remove_repeats(table(spark, docs).repartition(3), with_text=True).collect()
    want = brute.repeats(docs)
    assert len(got) == len(docs)
    for r in got:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]][:4], r["doc_id"]
        assert r["kept_text"] == want[r["doc_id"]][4].decode("utf-8", "ignore")


def test_repeats(spark, docs):
    check_repeats(spark, docs)


@pytest.mark.parametrize(("spread", "shard"), [(1, 1 << 19), (1, 500), (2048, 1 << 19), (2048, 300), (2048, 5000)])
def test_repeats_of_periodic_texts(spark, monkeypatch, spread, shard):
    # the limits only say how windows are dealt, and how much text a suffix array has
    monkeypatch.setattr(repeats, "SPREAD", spread)
    monkeypatch.setattr(repeats, "SHARD_BYTES", shard)
    rng = random.Random(5)
    base = ["".join(rng.choice("ab") for _ in range(400)) for _ in range(3)]
    docs = [(i, ("z" * rng.randrange(50, 1500) if i % 9 == 0 else "") + "".join(rng.choice(base)[k : k + rng.randrange(20, 250)] for k in rng.sample(range(300), rng.randrange(0, 5)))) for i in range(80)]
    check_repeats(spark, docs + [(90, "abcdefgh " * 40), (91, None), (92, "x" * 99)])


def test_repeats_of_periods_as_long_as_a_window_has_grams(spark):
    rng = random.Random(81)
    lines = {(period, times): "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=period - 1)) + "\n" for period in range(79, 84) for times in range(2, 9)}
    docs = [(i, line * times) for i, ((_, times), line) in enumerate(lines.items())]
    # no two texts share a gram, so each run of windows is the only one of its least gram
    assert all(brute.repeats([d])[d[0]] == want for d, want in zip(docs, brute.repeats(docs).values()))
    check_repeats(spark, docs)


def thue_morse(one, other, n):
    """A text on which polynomial hashes modulo 2**64 fail: equal sums with its opposite, whatever the odd base."""
    return "".join((one, other)[bin(k).count("1") & 1] for k in range(n))


def test_repeats_of_texts_with_equal_polynomials(spark):
    check_repeats(spark, [(i, thue_morse(*pair, n)) for i, (pair, n) in enumerate([("hm", 512), ("mh", 512), ("hm", 1024), ("mh", 2048), ("ac", 2048), ("ca", 2048)])])


def test_occurs():
    rng = np.random.default_rng(3)
    for length in (8, 13, 100):
        texts = [rng.integers(254, 256, 700).astype(np.uint8), rng.integers(254, 256, 900).astype(np.uint8)]
        texts[1][300:600] = texts[0][100:400]
        array = suffix_arrays.suffix_array(texts[1], length)
        array = array[array <= 900 - length]
        known = {texts[1][p : p + length].tobytes() for p in array}
        places = np.arange(700 - length)
        assert suffix_arrays.occurs(texts[0], places, texts[1], array, length).tolist() == [texts[0][p : p + length].tobytes() in known for p in places]


def test_repeats_of_repeated_ids(spark):
    text = "".join(random.Random(8).choices("abcdefgh", k=150))
    got = repeats.remove_repeats(table(spark, [(1, text), (1, text), (2, text), (2, "other"), (None, text)])).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"]))
    assert by[1] == [(150, 150)] * 2 and by[None] == [(150, 0)] and len(by[2]) == 2 and (5, 0) in by[2]


# --- 6 ------------------------------------------------------------------------------------------------------------


def test_warc(spark, tmp_path):
    pages = [(1, "http://a/ü\r\nX: y", "<p>é"), (2, None, "<p>é"), (3, "http://b", None), (4, "http://c", ""), (5, "http://d", "x" * 200_000), (6, "u", "solo"), (7, "u", "<p>é")] + [(i, f"http://{i}", f"<html>{i % 9} body</html>" * 20) for i in range(10, 120)]
    frame = spark.createDataFrame([(*p, "a", "b", 1) for p in pages], "page_id bigint, url string, html string, digest string, last string, salt int")
    files = warc.write_archives(frame.repartition(3), str(tmp_path / "w"))
    got = {r["page_id"]: r for r in warc.read_archives(files).collect()}
    last = {}
    for i, _, h in pages:
        last[h or ""] = max(last.get(h or "", 0), i)
    import base64
    import hashlib

    for i, u, h in pages:
        raw, r = (h or "").encode(), got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if last[h or ""] == i else ("revisit", last[h or ""]))
        assert r["url"] == u and (r["payload"] is None) == (r["record_type"] == "revisit")
        assert r["payload"] is None or bytes(r["payload"]) == raw
    path = files.first()["path"]
    with open(path.removeprefix("file:"), "rb") as f:
        assert f.read(4) == b"\x5d\x2a\x4d\x18"
    assert warc.write_archives(frame, str(tmp_path / "v"), min_revisit_bytes=1000).agg(F.sum("records")).first()[0] == len(pages)
    assert warc.archive_round_trip(frame.limit(0)).count() == 0
    doubled = warc.archive_round_trip(frame.limit(1).unionAll(frame.limit(1))).collect()
    assert [r["record_type"] for r in doubled] == ["response"] * 2


def test_urls_of_records():
    for url, written in (("http://x/a%20b%C3%A9", None), ("http://x/%", None), ("http://x/é ?q=[1]\n%41", "http://x/%C3%A9%20?q=[1]%0A%41"), ("", None)):
        record = warc.encode_record(1, url, b"p", None, False, "2024-01-01T00:00:00Z")
        assert warc.decode_record(record)["url"] == url
        assert f"WARC-Target-URI: {url if written is None else written}\r\n".encode() in record


# --- 7 ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("bound", [2 << 20, 100])
def test_decontamination(spark, frame, docs, bound):
    long = docs[-1][1].split()
    items = [(None, " ".join(long[500:512])), (None, " ".join(long[505:530])), (1, " ".join(long[50:75])), (2, "one TWO"), (3, ""), (4, None), (5, "nothing of this kind is there at all, not one bit of it"), (12, " ".join(long[70:90])), (6, "One two")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r["doc_id"]: r for r in decontamination.decontaminate(frame, benchmark, broadcast_bytes=bound).collect()}
    for i, t in docs:
        n, hit, found = brute.contamination(t, items)
        assert (got[i]["dc_words"], got[i]["dc_hit_words"], got[i]["dc_items"], got[i]["dc_contaminated"]) == (n, hit, found, hit > 0), i
    twice = decontamination.decontaminate(frame.where("doc_id = 60").unionAll(frame.where("doc_id = 60")), benchmark, broadcast_bytes=bound).collect()
    assert len(twice) == 2 and twice[0] == twice[1]
    cut = decontamination.decontaminate(frame, benchmark, remove="spans", broadcast_bytes=bound)
    assert {r["doc_id"]: r["text"] for r in cut.collect()}[4] == "!"
    assert decontamination.decontaminate(cut.select(*frame.columns), benchmark).where("dc_hit_words > 0 AND doc_id = 60").count() == 0
    assert decontamination.decontaminate(frame, benchmark, remove="documents").count() == len(docs) - sum(r["dc_contaminated"] for r in got.values())
    assert decontamination.decontaminate(frame, benchmark.limit(0)).where("dc_contaminated").count() == 0
    assert decontamination.items_digest([12, 2]) == spark.range(1).select(F.sha2(F.lit("12,2"), 256)).first()[0]


# --- 8 ------------------------------------------------------------------------------------------------------------


def check_jaccard(spark, docs):
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.jaccard_classes(table(spark, docs).repartition(3)).collect()}
    for (i, _), (group, links) in zip(docs, brute.jaccard_links(docs)):
        assert got[i] == (group, links), i


def test_jaccard(spark, docs):
    check_jaccard(spark, docs)
    assert jaccard.jaccard_classes(table(spark, [])).count() == 0


@pytest.mark.parametrize("members", [2, 4, 8])
def test_jaccard_of_a_large_group_in_blocks(spark, monkeypatch, members):
    # the limit only says how many tasks a bucket's pairs are spread over
    monkeypatch.setattr(jaccard, "BLOCK_MEMBERS", members)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(24):
        own = list(base)
        own[rng.randrange(120)] = f"x{i}"
        docs.append((i, " ".join(own)))
    check_jaccard(spark, docs + [(50, docs[3][1]), (51, docs[3][1].upper())])


def test_jaccard_of_words_with_equal_polynomials(spark):
    docs = [(i, thue_morse(*pair, n)) for i, (pair, n) in enumerate((pair, n) for n in (1024, 2048) for pair in ("ac", "ca"))]
    check_jaccard(spark, docs)
    check_jaccard(spark, [(i, f"one two three {t} four five six seven") for i, t in docs])


def test_grams_of_equal_hash_are_told_apart(monkeypatch):
    texts = [b"a b c d e f g", b"a b c d e f h", b"x y", b"", b"b c d e f g"]
    want = [(k, g) for k, t in enumerate(texts) for g in brute.shingles(t.decode())]
    for hashes in (jaccard.gram_hashes, lambda hashed, first, last, n: np.full(len(first), 7, np.uint64)):
        monkeypatch.setattr(jaccard, "gram_hashes", hashes)
        owner, gram = jaccard.exact_grams(texts, 5)
        assert len(owner) == len(want) and len(set(gram.tolist())) == len({g for _, g in want})
        assert jaccard.shared_counts(owner, gram, 5).tolist() == [[float(len(brute.shingles(a.decode()) & brute.shingles(b.decode()))) for b in texts] for a in texts]


def test_jaccard_of_rows_without_and_with_repeated_ids(spark):
    near = [" ".join(f"w{k}" for k in range(60)) + f" end{j}" for j in range(4)]
    docs = [(None, near[0]), (3, near[1]), (3, "something else altogether that nobody has said before"), (7, near[2]), (7, near[2]), (None, None), (9, "!")]
    got = sorted((tuple(r) for r in jaccard.jaccard_classes(table(spark, docs)).collect()), key=str)
    want = [(None, 3, None, 3), (3, 3, 3, 3), (3, 3, 3, 0), (7, 3, 7, 3), (7, 3, 7, 3), (None, None, None, 0), (9, 9, 9, 0)]
    assert got == sorted(want, key=str)
    # of the class the row of the least id stays, and with it the other text of that id
    left = jaccard.first_of_each_class(table(spark, docs))
    assert left.columns == table(spark, docs).columns
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted([(3, near[1]), (3, docs[2][1]), (None, None), (9, "!")], key=str)
    assert sorted(tuple(r) for r in jaccard.first_of_each_class(table(spark, [(1, "A"), (5, "A"), (5, "B")])).select("doc_id", "text").collect()) == [(1, "A"), (5, "B")]
    assert [tuple(r) for r in jaccard.first_of_each_class(table(spark, [(1, "A")] * 3)).select("doc_id", "text").collect()] == [(1, "A")]
    left = jaccard.first_of_each_class(table(spark, [(9, None), (9, ""), (9, ""), (9, None), (1, "A"), (2, "A")])).select("doc_id", "text").collect()
    assert sorted(map(str, map(tuple, left))) == ["(1, 'A')", "(9, '')", "(9, None)"]
    # two rows of the only texts without an id
    assert {tuple(r) for r in jaccard.jaccard_classes(table(spark, [(None, near[0]), (None, near[1])])).collect()} == {(None, None, None, 1)}


def test_bands():
    bands, rows = jaccard.choose_bands()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 5), (200, 201), (7, 7), (40, 0)]
    got = {r["node"]: r["root"] for r in jaccard.connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in [*range(1, 41), 100]) and got[201] == 200


# --- 9 ------------------------------------------------------------------------------------------------------------


def test_packing(spark, frame, docs, tokenizer):
    got = packing.pack(frame, queries.tokenizer_path(), capacity=256).toPandas()
    assert sorted(zip(got["doc_id"], got["piece"], got["start"], got["length"], got["ids_crc32"])) == brute.pieces(tokenizer, docs, 256)
    rows = got.sort_values(["sequence_id", "offset"])
    total = rows.groupby("sequence_id")["length"].cumsum()
    assert (total - rows["length"] == rows["offset"]).all() and total.max() <= 256
    # pieces of over half a sequence need one each
    assert got["sequence_id"].nunique() <= max(-(-got["length"].sum() // 256), (got["length"] > 128).sum()) * 1.01 + 2
    assert packing.pack(table(spark, []), queries.tokenizer_path()).count() == 0


def test_plan():
    rng = np.random.default_rng(1)
    for capacity, counts in ((2048, rng.integers(0, 40, 2049)), (50, rng.integers(0, 3, 51)), (10, np.zeros(11, int)), (7, np.eye(8, dtype=int)[7] * 5)):
        counts = np.array(counts)
        counts[0] = 0
        patterns = packing.plan_packing(counts, capacity)
        placed = np.zeros(capacity + 1, int)
        for lengths, n in patterns:
            assert sum(lengths) <= capacity and n > 0
            for x in lengths:
                placed[x] += n
        assert (placed == counts).all()
        least = -(-int((counts * np.arange(capacity + 1)).sum()) // capacity)
        assert sum(n for _, n in patterns) <= max(least, counts[capacity // 2 + 1 :].sum()) * 1.01 + 2


def test_sums_are_indexed():
    rng = np.random.default_rng(7)
    for _ in range(30):
        counts = np.where(rng.random(61) < 0.2, rng.integers(1, 4, 61), 0)
        counts[0] = 0
        pieces = [x for x in range(61) for _ in range(counts[x])]
        index = packing.SumIndex(counts)
        for total in range(1, 61):
            for size, found in ((1, index.single), (2, index.pair), (3, index.triple)):
                known = {tuple(sorted(c, reverse=True)) for c in itertools.combinations(pieces, size) if sum(c) == total}
                got = found(total)
                assert (tuple(sorted(got, reverse=True)) in known) if known else got is None


def test_plan_uses_sums_of_three():
    # 47 + 29 + 19 + 5 is the only exact filling there is
    counts = np.zeros(101, int)
    counts[[47, 29, 19, 5, 91]] = 3, 3, 4, 3, 1
    patterns = packing.plan_packing(counts, 100)
    assert ((47, 29, 19, 5), 3) in patterns
    assert sum(n for _, n in patterns) == 5


# --- 10 -----------------------------------------------------------------------------------------------------------


def test_nearest(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 64)).astype(np.float32)
    x[10] = x[11] = x[12]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(600, None), (601, [0.0] * 64), (602, [float("nan")] + [1.0] * 63), (603, [1.0] * 3), (604, [None] + [1.0] * 63), (605, [float("inf")] * 64), (None, [1.0] * 64), (606, [])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    got = nearest.nearest(frame, frame.where("vec_id % 20 = 0"), query_block=8).toPandas()
    hits = 0
    for q in range(0, 600, 20):
        score = np.array([float(np.add.accumulate(x[q].astype(float) * x[j])[-1]) for j in range(600)])
        score[q] = -np.inf
        want = np.lexsort((np.arange(600), -score))[:20]
        mine = got[got["query_id"] == q].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 21)) and (mine["score"].to_numpy() == score[mine["vec_id"]]).all()
        hits += len(set(mine["vec_id"]) & set(want))
    assert hits >= 0.99 * 30 * 20 and set(got["query_id"]) == set(range(0, 600, 20))
    few = frame.where("vec_id IN (0, 20, 40)")
    assert nearest.nearest(few, few).groupBy("query_id").count().where("count = 2").count() == 3
    assert nearest.nearest(frame.limit(0), frame.limit(0)).count() == 0


def test_codes_choose_what_is_reranked():
    """On vectors without structure, where bounds have the least to hold on to, the codes leave few pairs, and no neighbour is lost."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 64))
    x /= np.sqrt((x * x).sum(1))[:, None]
    ids, centre = np.arange(2000), x.mean(0)
    off = x - centre
    radius = np.sqrt((off * off).sum(1))
    codes, scalars = nearest.encode_vectors(off / radius[:, None] @ nearest.rotation(64))
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[i : i + 500]), *(pa.array([v.tobytes() for v in p[i : i + 500]], pa.binary()) for p in (x, codes, scalars)), pa.array(radius[i : i + 500])], names=["vec_id", "vector", "code", "scalars", "radius"]) for i in range(0, 2000, 500)]

    class Shipped:
        value = nearest.QueryBlock(ids[::20], x[::20], centre)

    counted = {}
    (found,) = nearest._search(Shipped, 20, 64, counted)(iter(batches))
    scores = x[::20] @ x.T
    scores[np.arange(100), ids[::20]] = -9
    best = {int(q): set(np.argsort(-s)[:20].tolist()) for q, s in zip(ids[::20], scores)}
    got = {}
    for q, v in zip(found["query_id"].to_pylist(), found["vec_id"].to_pylist()):
        got.setdefault(q, set()).add(v)
    assert got == best
    shares = [counted[j] / counted["pairs"] for j in range(1, nearest.CODES + 1)]
    assert shares == sorted(shares, reverse=True) and counted["reranked"] / counted["pairs"] < 0.1


@pytest.mark.parametrize("broadcast_bytes", [decontamination.BROADCAST_BYTES, 50])
def test_items_with_names(spark, broadcast_bytes):
    """Ids that are no numbers are strings, in one pass and in several."""
    items = [("q-1", "alpha beta gamma"), ("q-2", "one two three four five six seven eight nine ten eleven"), (None, "no name here")]
    docs = [(1, "say Alpha, beta gamma; one two three four five six seven eight nine ten"), (2, "no name here"), (3, None)]
    found = decontamination.decontaminate(table(spark, docs), spark.createDataFrame(items, "item_id string, text string"), broadcast_bytes=broadcast_bytes)
    assert {r["doc_id"]: (r["dc_items"], r["dc_hit_words"]) for r in found.collect()} == {1: (["q-1", "q-2"], 13), 2: ([], 3), 3: ([], 0)}
