"""The corpus pipeline: stages over ``documents``, each written as Parquet and read by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from narae.llm.decontaminate import decontaminated
from narae.llm.jaccard import one_of_each
from narae.llm.mixing import mixed_documents
from narae.llm.quality import keep_quality
from narae.llm.shared import materialise, table_path
from narae.llm.tokens import token_digest


def _frugal(spark: SparkSession) -> None:
    """Stages follow one another in the same executors: what they hand to Python goes by the megabyte."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    _frugal(spark)
    return keep_quality(docs, spark.read.parquet(table_path(sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard similarity 0.8 or more)."""
    _frugal(spark)
    return one_of_each(docs, n=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; documents that are mostly such passages go."""
    _frugal(spark)
    return decontaminated(docs, spark.read.parquet(table_path(sf_dir, "benchmark")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: repeated whole, then cut."""
    _frugal(spark)
    return mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id files of the mix, and where each document stands in them.

    Workers of all stages share an executor's memory, so files are smaller and few words remembered here.
    """
    _frugal(spark)
    return token_digest(docs, public_tokenizers.path("word_bpe_49k.json"), file_ids=1 << 19, words=(100_000, 50_000))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_ids", token_ids),
]

#: A fitted classifier is beyond SQL; tests hold the pipeline against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    docs = spark.read.parquet(table_path(sf_dir, "documents"))
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, name)
    return docs
