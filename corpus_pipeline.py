"""The corpus pipeline: toxicity, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``, whatever they are called.
``run`` writes each stage's result as Parquet in the shared folder and reads it again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.common import fresh_dir, short_batches
from sessionloom.llm.decontamination import clean_documents
from sessionloom.llm.jaccard import first_of_each_class
from sessionloom.llm.packing import pack
from sessionloom.llm.queries import remainder, tokenizer_path
from sessionloom.llm.repeats import without_repeats
from sessionloom.llm.toxicity import TOXIC, reject_toxic, train_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC; weights are learnt from the labelled documents, without the held-out quarter.

    Where no weights can be learnt (``labels`` is empty or has no usable row outside that quarter), nothing is known of any document and all stay.
    """
    short_batches(spark)
    weights = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), usable=remainder() != 2)
    return reject_toxic(docs, weights, TOXIC)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents connected by a similarity of 0.8 or more, the one with the least doc_id; what goes goes by doc_id and text together."""
    return first_of_each_class(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 100-byte strings that start earlier; documents of which nothing is left go. n_chars, where there is one, follows the text."""
    left = without_repeats(docs)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType))
    return left


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents' tokens, packed into sequences of 2048."""
    return pack(docs, tokenizer_path())


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("benchmark_leaks", benchmark_leaks), ("packing", packing)]

#: SQL can express neither the learnt scores nor the suffix arrays; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = fresh_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
