"""The corpus pipeline: quality rules, near-dedup, decontamination, personal data, token ids.

Each stage takes all documents its predecessor kept, with the columns of ``documents``, and its
decisions take effect. Empty tables pass through; a NULL text has no words, so the first stage
rejects it; further columns of the documents travel along.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.llm import decontam, neardup, pieces, pii, quality
from marketlake.session import materialize, small_batches

#: Bytes of rows sent to Python at a time, and of text encoded at a time: a worker's memory stays small beside a full heap.
BATCH_BYTES, SLICE_BYTES = 4_000_000, 500_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that base rule and compression bands keep."""
    return quality.quality(docs, keep=docs.columns).where("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group of near-duplicates (five words, 0.8).

    Equal rows of one id count once; documents without an id are no group and stay.
    """
    join = neardup.Join(words=5)
    kept = neardup.near_duplicates(docs, join).where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return named.union(docs.where("doc_id is null"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any 10-word window of the benchmark."""
    found = decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=docs.columns)
    return found.where("size(hits) = 0").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every span of personal data replaced by its kind."""
    cleaned = pii.redact(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cleaned


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they decode to the text again."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    back = pieces.encode(docs.select("doc_id", "text", "lang", "source"), model, decoded="decoded", slice_bytes=SLICE_BYTES)
    out = back.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                      (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))
    # Written here, so that the size of what Python gets holds.
    with small_batches(spark, BATCH_BYTES):
        return materialize(out, "token-ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules), ("near_dedup", near_dedup), ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data), ("token_ids", token_ids)]

#: zstandard ratios and the library's merges are beyond SQL; tests/llm compares with plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage keeps is written to the shared folder for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
