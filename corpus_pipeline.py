"""The cleaning pipeline over ``documents``: stages applied one after the other, each on what the last one kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from convoy.llm.bpe import encode_documents
from convoy.llm.common import stage, table
from convoy.llm.decontaminate import drop_contaminated
from convoy.llm.line_runs import drop_repeated_runs
from convoy.llm.minhash import drop_near_duplicates
from convoy.llm.toxicity import toxicity_column

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Score from which a document is rejected as toxic.
TOXIC = 0.7
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC, with all their columns."""
    score = toxicity_column(docs, table(spark, sf_dir, "labels"))
    return docs.where(score("text") < TOXIC)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs; n_chars follows the text where the input has it.

    A document goes when nothing with a word is left of it, as all of it stands in earlier ones.
    """
    kept = drop_repeated_runs(docs).where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^ \t\r\n\f\x0B]"))
    if "n_chars" in docs.columns:
        length = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
        kept = kept.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of every group linked by word-5-gram similarity of 0.8 or more."""
    return drop_near_duplicates(docs, width=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (packed as little-endian unsigned 32-bit integers), and the decoded bytes' digest."""
    coded = encode_documents(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]
#: The toxicity model and the encoding cannot be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; each stage's rows are written and read back for the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, fn) in enumerate(STAGES):
        docs = fn(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, f"pipeline-{k}-{name}")
    return docs
