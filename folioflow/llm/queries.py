"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import bpe, chat, decontaminate, langid, licenses, quality_model, quality_rules, substring_dedup, suffixarray, superminhash


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its sentences, those removed as later places of a repeated run, and the rest."""
    got = substring_dedup.repeated_sentences(_table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_sentences", F.size("gone").cast("bigint").alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return chat.chat_digests(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: how many passages were confirmed, and their licenses."""
    got = licenses.scan_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    exact = F.size(F.filter("found", lambda x: (F.size(x.missing) == 0) & (F.size(x.added) == 0)))
    return got.select("row.doc_id", F.size("found").cast("bigint").alias("n_found"), exact.cast("bigint").alias("n_exact"), F.array_join(F.array_sort(F.array_distinct("found.license")), ",").alias("licenses"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=2)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns by strings of 400 bytes, and n_passage: bytes in passages of 50 words and more of which
    every 250 bytes also start elsewhere, found in the same pass and left in place."""
    got = suffixarray.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), length=400, passages=250, gram=80)
    lengths = F.aggregate(F.transform("passages", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return got.select("row.doc_id", "n_bytes", "n_removed", (F.size("spans") / 2).cast("bigint").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"), lengths.alias("n_passage"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_chat_formatting, op3_quality_classifier, op4_quality_rules, op5_license_scans, op6_byte_bpe, op7_decontamination, op8_language_id, op9_minhash_dedup, op10_suffix_array_dedup)}


def oracle_sql() -> dict[str, str]:
    from folioflow.llm import oracles

    return oracles.SQL
