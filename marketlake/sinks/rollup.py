"""Row counts per market and week, kept while a series is written.

Each batch adds its own counts to a log that merges them, late rows included, so coverage and
status read a few rows for each market instead of the series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .append import append_series, with_week
from .log import MERGE_AFTER, Log


class Rollup:
    """Counts, first and last time per (platform, market, week) of one series."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str] | None = None, merge_after: int = MERGE_AFTER) -> None:
        self.keys = [*(keys or ["platform", "market_id"]), "week"]
        self.log = Log(spark, path, self._merge, merge_after)

    def _merge(self, rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
        return rows.groupBy(*(keys or self.keys)).agg(F.sum("n").alias("n"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))

    def add(self, rows: DataFrame, batch: str, time: str = "ts") -> bool:
        """Add the counts of a batch; a batch that is there already adds nothing."""
        counts = with_week(rows, time).groupBy(*self.keys).agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("first_ts"), F.max(time).alias("last_ts"))
        return self.log.append(counts, batch)

    def weeks(self) -> DataFrame | None:
        """Counts per market and week; None before the first batch."""
        rows = self.log.read()
        return None if rows is None else self._merge(rows)

    def markets(self) -> DataFrame | None:
        """Counts per market, over all weeks."""
        rows = self.log.read()
        return None if rows is None else self._merge(rows, self.keys[:-1])


def append_counted(df: DataFrame, path: str, rollup: Rollup, batch: str, time: str = "ts") -> bool:
    """Append a batch to its series and its counts to the rollup, once each.

    The counts come last: a run lost between the two repeats the batch, which the caller's own log
    of batches keeps from being appended twice.
    """
    if batch in rollup.log.manifest()["batches"]:
        return False
    append_series(df, path, time=time)
    return rollup.add(df, batch, time)
