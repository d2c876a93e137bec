"""Stored tables and landing files with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import LANDING, TABLES


def scan_table(spark: SparkSession, root: str, name: str, fmt: str = "parquet") -> DataFrame:
    """One stored table. Parquet, ORC, JSON or CSV (with header); nothing is inferred.

    Times inside CSV and JSON are read as UTC text.
    """
    reader = spark.read.schema(TABLES[name])
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(f"{root}/{name}")


def scan_tables(spark: SparkSession, root: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    return {name: scan_table(spark, root, name, fmt) for name in TABLES}


def scan_landing(spark: SparkSession, path: str) -> DataFrame:
    """Raw documents, one per line, as ``value``."""
    return spark.read.schema(LANDING).text(path)


def scan_landing_documents(spark: SparkSession, path: str) -> DataFrame:
    """Raw documents, one per file, as ``value`` with the file's ``path``."""
    return (spark.read.option("wholetext", True).text(path)
            .select("value", F.col("_metadata.file_path").alias("path")))


def landing_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """The same documents as a stream of newly landed files."""
    return (spark.readStream.schema(LANDING).option("maxFilesPerTrigger", max_files).text(path))
