"""Series tables as append-only Parquet, partitioned by platform and week."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import micros


def with_week(df: DataFrame, time: str = "ts") -> DataFrame:
    """Add the week's Monday as ``week``."""
    return df.withColumn("week", F.to_date(F.date_trunc("week", F.timestamp_micros(micros(F.col(time))))))


def append_series(df: DataFrame, path: str, *, time: str = "ts", platform: str = "platform",
                  sort: list[str] | None = None, mode: str = "append") -> None:
    """Append rows under ``platform=/week=``, clustered by market and time inside files.

    Rows are range-partitioned by (platform, week, market, time), so a busy platform,
    week or market is spread over several tasks and each file covers a narrow range
    that min/max statistics can skip.
    """
    sort = sort or ["market_id", time]
    weekly = with_week(df, time)
    (weekly.repartitionByRange(platform, "week", *sort)
     .sortWithinPartitions(platform, "week", *sort)
     .write.mode(mode).partitionBy(platform, "week").parquet(path))


def read_series(spark: SparkSession, path: str, *, first: str | None = None, last: str | None = None,
                time: str = "ts") -> DataFrame:
    """Series rows, optionally of a time range (ISO text); the range also prunes weeks."""
    df = spark.read.parquet(path)
    if first:
        start = F.to_timestamp(F.lit(first))
        df = df.filter((F.col(time) >= start) & (F.col("week") >= F.to_date(F.date_trunc("week", start))))
    if last:
        end = F.to_timestamp(F.lit(last))
        df = df.filter((F.col(time) <= end) & (F.col("week") <= F.to_date(F.date_trunc("week", end))))
    return df.drop("week")
