"""Quality, near-dedup, repeated strings, decontamination, tokens: documents to training rows.

Each stage takes (spark, docs, sf_dir) and all rows that its predecessor kept. Parameters are those of
production: word shingles of five words, a similarity of 0.8, passages of 50 words found by strings of 200
bytes, windows of 13 words.

Nulls, empty texts, repeated rows and extra columns: every stage but the last returns the columns that it got.
A null or empty text is scored by the classifier's bias, has no near-duplicates, repeats, benchmark words or tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import bpe, decontaminate, quality_model, suffixarray, superminhash
from folioflow.llm.shared import drop, keep, tidy


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled ones, doesn't reject: a score of 0.3 or more.
    Null and empty texts score the bias alone; without labels of both kinds every score is 0.5 and all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = quality_model.fit(quality_model.labelled(docs, labels))
    return quality_model.score(docs, weights).where("score >= 0.3").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id, of equal ids the one
    with the least hash of its text, of equal rows one. Documents without words all stay."""
    return superminhash.keep_one(docs, shingle=5, percent=80)


def string_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 50 words and more of which every 200 bytes also start elsewhere,
    in all places where they stand; ``n_chars``, if there, counts what is left. Documents that lose
    nothing keep their text and ``n_chars`` as they are, null ones too."""
    got = suffixarray.remove_repeats(docs, length=200, gram=64, min_words=50)
    new = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return got.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than one in twenty stands in a passage of the benchmark. Null items hit
    nothing; documents without words stay."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contamination(docs, benchmark).where("not (n_hit > 0 and 20 * n_hit >= n_words)").select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it; a null text has no ids and decodes to ''."""
    got = bpe.encode(docs)
    return got.select("row.doc_id", "row.lang", "row.source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "decodes")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("string_dedup", string_dedup), ("decontamination", decontamination), ("tokens", tokens)]

#: SuperMinHash groups, suffix arrays and learned scores are not for SQL; tests/llm compares brute force
ORACLE_SQL = None


@tidy
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; each one's rows are written, and those before them dropped."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
