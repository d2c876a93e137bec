"""Write rules on stored series: only the weeks that change are written again.

A series lies under ``platform=/week=``. The weeks of the incoming rows are read, the rule is
applied, and dynamic partition overwrite replaces those whose rows differ from what is stored.
Every other file keeps its name, and a repeated batch writes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.merge import insert_if_absent, last_write_wins, partial_upsert, set_fields
from ..operators.ordered import null_safe_join
from ..session import materialize
from .append import with_week

Rule = Callable[[DataFrame, DataFrame], DataFrame]


def latest(keys: list[str], seq: list[str]) -> Rule:
    """Incoming rows replace stored ones of their key; among themselves the last by ``seq`` counts."""
    def rule(stored: DataFrame, incoming: DataFrame) -> DataFrame:
        both = stored.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
        return last_write_wins(both, keys, ["__new", *seq]).drop("__new")
    return rule


def absent(keys: list[str], seq: list[str]) -> Rule:
    """Only rows of keys that are not stored are added, the first by ``seq``."""
    return lambda stored, incoming: stored.unionByName(insert_if_absent(incoming, keys, seq, stored))


def partly(keys: list[str], update: list[str]) -> Rule:
    """New keys whole, of stored ones the ``update`` columns; one incoming row per key."""
    return lambda stored, incoming: partial_upsert(stored, incoming, keys, update)


def patched(keys: list[str], fields: list[str], greatest: list[str] = ()) -> Rule:
    """Stored keys take the non-NULL ``fields``; nothing is added."""
    return lambda stored, incoming: set_fields(stored, incoming, keys, fields, greatest)


def upsert(incoming: DataFrame, path: str, rule: Rule, *, time: str = "ts", platform: str = "platform",
           sort: list[str] | None = None) -> int:
    """Apply a rule to the stored weeks that ``incoming`` touches; returns how many were written.

    The merged rows are written aside first, so a run lost while weeks are replaced is
    repeated on whole rows: stored and incoming rows are both still there. Time belongs to the key, so a
    key never changes its week.
    """
    spark, parts = incoming.sparkSession, [platform, "week"]
    new = with_week(incoming, time)
    touched = materialize(new.select(*parts).distinct(), "touched-weeks")
    try:
        stored = spark.read.schema(new.schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], new.schema)
    weeks = [r["week"] for r in touched.select("week").distinct().collect()]
    old = stored.filter(F.col("week").isin([w for w in weeks if w is not None]) | (F.col("week").isNull() if None in weeks else F.lit(False)))
    old = null_safe_join(old, touched, parts, "left_semi").select(*new.columns)
    merged = materialize(rule(old, new).select(*new.columns), "merged-weeks")

    def summary(df: DataFrame, name: str) -> DataFrame:
        rows = F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*new.columns).cast("decimal(38, 0)")).alias("h"))
        return df.groupBy(*parts).agg(rows.alias(name))

    both = null_safe_join(summary(merged, "now"), summary(old, "was"), parts, "left")
    changed = materialize(both.filter(~F.col("now").eqNullSafe(F.col("was"))).select(*parts), "changed-weeks")
    n = changed.count()
    if n:
        order = sort or [time]
        (null_safe_join(merged, changed, parts, "left_semi").select(*new.columns)
         .repartitionByRange(*parts, *order).sortWithinPartitions(*parts, *order)
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path))
    return n
