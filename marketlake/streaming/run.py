"""Start and finish streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..session import STREAM_CONF, scratch_path

WATERMARK_SECONDS = 600


def use_rocksdb(spark: SparkSession) -> None:
    """State larger than memory; needed by the keyed operators."""
    for key, value in STREAM_CONF.items():
        spark.conf.set(key, value)


def start_parquet(df: DataFrame, path: str, checkpoint: str, *, available_now: bool = False,
                  interval: str = "5 seconds", partition_by: list[str] | None = None) -> StreamingQuery:
    """Append a stream to Parquet; the checkpoint makes restarts exactly-once."""
    use_rocksdb(df.sparkSession)
    writer = (df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start(path)


def drain(df: DataFrame, name: str) -> DataFrame:
    """Process everything that has landed, then read the result back as a table."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    query = start_parquet(df, f"{path}/out", f"{path}/checkpoint", available_now=True)
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out")
