"""Register of queries: name, DataFrame builder and, where SQL can say it, an equal SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import micros
from ..session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(t)`` where ``t(table)`` reads one of the given tables."""
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return fn
    return add


def rounded(expr: str, digits: int) -> str:
    """SQL text of ``functions.numbers.sql_round``."""
    return f"CAST(round(CAST({expr} AS DECIMAL(30, 12)), {digits}) AS DOUBLE)"


class Tables:
    """The given Parquet tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = configure(spark), sf_dir
        self._read: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        """A table; its footer is read once per query."""
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._read[name]

    def events(self, *kinds: str) -> DataFrame:
        """Events (of the named kinds) with the time as microseconds ``t`` and seconds ``s``."""
        e = self("events")
        if kinds:
            e = e.filter(F.col("event_type").isin(*kinds))
        return (e.withColumn("t", micros(F.col("ts")))
                .withColumn("s", F.floor(F.col("t") / 1_000_000).cast("bigint")))
