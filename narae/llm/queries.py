"""The registered queries of the dealt operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from narae.llm.shared import table_path


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, table))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from narae.llm.mixing import mix_sources

    return mix_sources(_read(spark, sf_dir, "documents"))


def op2_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    from narae.llm.matroska import media_digest

    return media_digest(_read(spark, sf_dir, "documents"))


def op3_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from narae.llm.pitman_yor import language_scores

    return language_scores(_read(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from narae.llm.decontaminate import leak_digest

    return leak_digest(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from narae.llm.warc import warc_digest

    return warc_digest(_read(spark, sf_dir, "pages"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from narae.llm.jaccard import jaccard_components

    return jaccard_components(_read(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from narae.llm.tokens import token_digest

    return token_digest(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from narae.llm.quality import quality_scores

    return quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from narae.llm.substring import dedup_digest

    return dedup_digest(_read(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from narae.llm.secrets import secret_digest

    return secret_digest(_read(spark, sf_dir, "documents"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from narae.llm.toxicity import toxicity_scores

    return toxicity_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op12_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from narae.llm.conversations import damaged, repair_digest

    return repair_digest(damaged(_read(spark, sf_dir, "conversations")))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from narae.llm.merkle import manifest

    return manifest(_read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_matroska": op2_matroska,
    "op3_pitman_yor": op3_pitman_yor,
    "op4_decontaminate": op4_decontaminate,
    "op5_warc": op5_warc,
    "op6_jaccard": op6_jaccard,
    "op7_tokens": op7_tokens,
    "op8_quality": op8_quality,
    "op9_substring": op9_substring,
    "op10_secrets": op10_secrets,
    "op11_toxicity": op11_toxicity,
    "op12_repair_conversations": op12_repair_conversations,
    "op13_merkle": op13_merkle,
}
