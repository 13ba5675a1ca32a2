"""The queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import common, decontaminate, extract, lm_score, neardup, neighbours, packing, pii, quality, secrets, toxicity


def tokenizer_path() -> str:
    """Where public_tokenizers keeps the vocabulary; the operator takes it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(common.table(spark, sf_dir, "documents"), secrets.Models(secrets.labelled_samples(spark)))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(common.table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents"), tokenizer_path())


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(common.table(spark, sf_dir, "documents"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.report(common.table(spark, sf_dir, "embeddings"))


def op7_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.report(common.table(spark, sf_dir, "pages"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(common.table(spark, sf_dir, "documents"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.report(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_secrets, op2_decontaminate, op3_neardup, op4_packing, op5_pii, op6_neighbours, op7_extract, op8_quality, op9_lm_score, op10_toxicity)
    return {f.__name__: f for f in own}
