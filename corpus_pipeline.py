"""The corpus pipeline: each stage applies one corpus operator to all that the stage before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``docs``. ``run`` writes what a stage returns as
Parquet in the shared folder and reads it back for the next one. Null and empty
texts, repeated rows, empty tables and extra columns are handled as the
operators' docstrings say; a row is dropped only by the decision of its stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slidegrid.llm import ngram_join, packing, pii, suffix_dedup, toxicity
from slidegrid.llm.text import materialize


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of few megabytes, so that long ones do not add up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; those that it reaches go."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~toxicity.held_out(1, 3))
    return toxicity.keep_clean(docs, toxicity.train(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    small_batches(spark)
    return ngram_join.keep_first(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the long passages that they copy from a smaller id."""
    small_batches(spark)
    return suffix_dedup.cut_copies(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by the name of its kind."""
    small_batches(spark)
    return pii.redact(docs, pii.train(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens as pieces of packed sequences."""
    small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("pii", redact_personal_data),
    ("packing", pack),
]

#: SQL cannot express the trained stages; tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
