"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ruleloom.llm import chat, fingerprint, jaccard, licenses, mixing, neighbours, packing, quality, secrets, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame(chat.PLANTED, "conv_id long, turn long, role string, text string")
    messages = rows.unionByName(planted).withColumn("parts", chat.text_part("text"))
    return chat.digests(chat.format_chats(messages))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digests(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_with_edits(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {"op1_chat_formatting": op1_chat_formatting, "op2_jaccard_join": op2_jaccard_join, "op3_mixing": op3_mixing, "op4_nearest": op4_nearest, "op5_toxicity": op5_toxicity, "op6_quality": op6_quality, "op7_licenses": op7_licenses, "op8_secrets": op8_secrets, "op9_packing": op9_packing, "op10_winnow": op10_winnow}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": chat.sql()}
