"""The operators bound to the given tables, and equal SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.llm import alignment, collocations, decontam, language, mixing, neardup, passages, pieces, pii, quality, tokens, toxicity, wrappers
from marketlake.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word, symbol and line counts with the verdict of base rule and compression bands."""
    return quality.quality(table(spark, sf_dir, "documents"))


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside a 10-word benchmark window."""
    return decontam.digest(decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


SQL["op5_decontamination"] = decontam.SQL


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = language.learn(docs.where(~language.held_out(docs["doc_id"])))
    out = language.predict(docs, model)
    return out.withColumn("held_out", language.held_out(out["doc_id"]))


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by the given vocabulary, and the text they decode to."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = pieces.encode(docs, model).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), "ids")
    return pieces.decode(ids, model).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written in ascending order of id and read back."""
    path = scratch_path(spark, "tokens")
    manifest = tokens.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return tokens.read(manifest, path, with_ids=False)


@query
def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


SQL["op3_personal_data"] = pii.SQL


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels of documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", language.held_out(out["doc_id"]).alias("held_out"), "score", "predicted")


@query
def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with similar 4-word shingle sets."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


SQL["op2_near_duplicates"] = neardup.SQL


@query
def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page through the wrapper of its host."""
    return wrappers.extract(table(spark, sf_dir, "pages"))


@query
def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of at least 50 words that occur in another document too."""
    return passages.passages(table(spark, sf_dir, "documents"))


@query
def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, by target weights of the sources."""
    return mixing.digest(mixing.repetitions(table(spark, sf_dir, "documents")))


SQL["op13_source_mix"] = mixing.SQL


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first phrases of each language by how firmly their words hold together."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


SQL["op12_collocations"] = collocations.SQL


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two vocabularies' tokens in every document, with the links' counts in all documents."""
    docs, _ = alignment.alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                  public_tokenizers.path("piece_bpe_32k.model"))
    return docs
