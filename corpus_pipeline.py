"""Documents to training tokens: language ID, exact dedup, near-dedup, decontamination, byte-level BPE."""

from __future__ import annotations

from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normloom.llm import byte_bpe, decontaminate, exact_dedup, language_id, simhash
from normloom.llm.shared import column, packed, shared_folder, table, unpacked

#: Probability below which a document's language counts as undecided.
LEAST_SCORE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those whose language is undecided."""
    judged = language_id.identify(packed(docs, doc_id=column("doc_id"), text=column("text"), lang=column("lang")))
    return unpacked(judged.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)), docs.columns)


def one_of_equal_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the token ids of each whole text, their number, and whether they decode to the text's bytes."""
    bpe = byte_bpe.ByteBpe(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = bpe.round_trip(docs)
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return coded.withColumns({"n_tokens": F.size("ids").cast("long"), "round_trip": same}).drop("decoded")


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", one_of_equal_texts),
    ("near_dedup", one_of_near_copies),
    ("decontamination", without_benchmark),
    ("byte_bpe", tokens),
]

#: The first, third and last stages cannot be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
