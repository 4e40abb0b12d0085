"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm import oracles
from sessionloom.llm.centroids import centroid_clusters
from sessionloom.llm.chat import digests, read_chats, turn_events, write_chats
from sessionloom.llm.collocations import collocations
from sessionloom.llm.common import fresh_dir, short_batches
from sessionloom.llm.decontamination import decontaminate
from sessionloom.llm.jaccard import jaccard_classes
from sessionloom.llm.nearest import nearest
from sessionloom.llm.packing import pack
from sessionloom.llm.repeats import remove_repeats
from sessionloom.llm.sharding import histogram_shards
from sessionloom.llm.token_files import token_round_trip
from sessionloom.llm.toxicity import TOXIC, score_toxicity, train_toxicity
from sessionloom.llm.url_filters import url_filter
from sessionloom.llm.warc import archive_round_trip

TOKENIZER = "word_bpe_49k.json"
URL_RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def remainder(doc_id: str = "doc_id"):
    return F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 4


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{r}', '{v}')" for r, v in URL_RULES) + " AS rules(rule, verdict)")
    return url_filter(_table(spark, sf_dir, "pages"), rules)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_shards(_table(spark, sf_dir, "documents"), 24)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_round_trip(_table(spark, sf_dir, "documents"), tokenizer_path())


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    weights = train_toxicity(documents, _table(spark, sf_dir, "labels"), usable=remainder() != 2)
    scored = score_toxicity(documents, weights)
    return scored.select("doc_id", F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a row a document, written by few tasks and not by those that hold the texts
    return remove_repeats(_table(spark, sf_dir, "documents")).hint("rebalance")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("dc_items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id",
        F.col("dc_words").alias("n_words"),
        F.col("dc_hit_words").alias("n_hit"),
        F.size("dc_items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        F.col("dc_contaminated").alias("contaminated"),
    )


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = _table(spark, sf_dir, "embeddings")
    return nearest(embeddings, embeddings.where(F.col("vec_id") % 20 == 0))


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = f"'{oracles.CONTROL_TURN}'"
    more = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', {said}), (-1L, 1L, 'assistant', {said}) AS t(conv_id, turn, role, text)")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    path = fresh_dir(spark, "chats")
    write_chats(turn_events(rows), path)
    return digests(read_chats(spark, path))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filters, op2_sharding, op3_token_files, op4_toxicity, op5_suffix_dedup, op6_warc, op7_decontamination, op8_jaccard_join, op9_packing, op10_nearest, op11_chat, op12_collocations, op13_centroids)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filters": oracles.url_filters(URL_RULES),
        "op5_suffix_dedup": oracles.SUFFIX_DEDUP,
        "op6_warc": oracles.WARC,
        "op7_decontamination": oracles.DECONTAMINATION,
        "op8_jaccard_join": oracles.JACCARD,
        "op10_nearest": oracles.NEAREST,
        "op11_chat": oracles.CHAT,
        "op12_collocations": oracles.COLLOCATIONS,
        "op13_centroids": oracles.centroids(),
    }
