"""The pipeline against a plain version of its stages, and the registered queries."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("sessionloom.llm.queries")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from sessionloom.llm import queries  # noqa: E402
from sessionloom.llm.toxicity import score_toxicity, train_toxicity  # noqa: E402
from tests.llm import brute  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def test_pipeline(spark):
    tokenizers = pytest.importorskip("tokenizers")
    read = lambda name: spark.read.parquet(f"{DATA}/{name}.parquet")
    documents = read("documents")
    weights = train_toxicity(documents, read("labels"), usable=queries.remainder() != 2)
    score = {r["doc_id"]: r["score"] for r in score_toxicity(documents, weights).collect()}
    docs = [(r["doc_id"], r["text"]) for r in documents.collect() if score[r["doc_id"]] < corpus_pipeline.TOXIC]
    docs = [d for d, (group, _) in zip(docs, brute.jaccard_links(docs)) if d[0] == group]
    cut = brute.repeats(docs)
    docs = [(i, cut[i][4].decode("utf-8", "ignore")) for i, _ in docs if not cut[i][0] or cut[i][1] < cut[i][0]]
    items = [(r["item_id"], r["text"]) for r in read("benchmark").collect()]
    docs = [(i, t) for i, t in docs if not brute.contamination(t, items)[1]]
    got = corpus_pipeline.run(spark, DATA).toPandas()
    want = brute.pieces(tokenizers.Tokenizer.from_file(queries.tokenizer_path()), docs)
    assert sorted(zip(got["doc_id"], got["piece"], got["start"], got["length"], got["ids_crc32"])) == want
    assert got["sequence_id"].nunique() <= -(-int(np.sum(got["length"])) // 2048) + 2


CLASHING = ("score", "toxicity", "score_text", "host", "dc_text", "dc_spans", "kept_text", "runs", "t", "doc", "band", "n_bytes", "rank", "root", "gone_doc", "text_key", "c0", "c1", "no_text")


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    wide = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHING})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, got = stage(spark, docs, DATA), stage(spark, wide, DATA)
        assert plain.columns == docs.columns and got.columns == wide.columns
        assert sorted(map(str, plain.collect())) == sorted(map(str, got.select(docs.columns).collect())), name
        assert got.where(" OR ".join(f"`{c}` IS DISTINCT FROM concat('{c}', doc_id)" for c in CLASHING)).isEmpty()


def test_stages_of_null_empty_and_repeated_rows(spark):
    first = spark.read.parquet(f"{DATA}/documents.parquet")
    long = first.orderBy(F.desc("n_chars")).first()["text"]
    odd = spark.createDataFrame([(None, None), (None, long), (None, long), (900001, None), (900002, ""), (900003, "!"), (900003, "!"), (900004, long), (900004, "quite another text of this number, which is not to go")], "doc_id bigint, text string").selectExpr("doc_id", "text", "cast(null AS string) AS lang", "cast(null AS string) AS source", "cast(null AS bigint) AS n_chars")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, first.limit(0), DATA).isEmpty()
        docs = first.unionByName(odd)
        got = stage(spark, docs, DATA)
        kept = {(r["doc_id"], r["text"]) for r in got.collect()} if name != "packing" else set()
        if name != "packing":
            assert {(900001, None), (900002, ""), (900003, "!"), (900004, odd.collect()[-1]["text"])} <= kept, name


def test_toxicity_stage_rejects_what_the_operator_predicts(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = {r["doc_id"] for r in corpus_pipeline.toxicity(spark, docs, folder).select("doc_id").collect()}
    scored = queries.op4_toxicity(spark, folder).collect()
    assert any(0.3 <= r["score"] < 0.5 for r in scored)
    assert left == {r["doc_id"] for r in scored if not r["predicted"]}


@pytest.mark.parametrize("rows", ["doc_id IS NULL AND doc_id IS NOT NULL", "crc32(encode(cast(doc_id AS string), 'UTF-8')) % 4 = 2", "toxic IS NULL"])
def test_toxicity_without_usable_labels_keeps_all(spark, tmp_path, rows):
    docs, labels = (spark.read.parquet(f"{DATA}/{name}.parquet") for name in ("documents", "labels"))
    labels.where(rows).write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.toxicity(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and got.count() == docs.count() > 0
    assert got.exceptAll(docs).isEmpty()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles(spark, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = queries.queries()[name](spark, DATA).toPandas(), connection.sql(queries.oracle_sql()[name]).df()
    rows = lambda df: sorted(map(str, df[sorted(df.columns)].astype(object).where(df.notna(), None).to_dict("records")))
    assert rows(got) == rows(want)
