"""Streaming operators made of built-in ones."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..constants import WATCH_AFTER, WATCH_BEFORE
from ..operators.intervals import BASE_BITS, dyadic_cover, dyadic_node
from ..operators.merge import coalesce_merge, new_rows
from ..sinks.append import with_week
from ..sinks.log import Log


def start_trade_sink(trades: DataFrame, path: str, checkpoint: str, keys: list[str], *, time: str = "ts",
                     available_now: bool = False) -> StreamingQuery:
    """Append every trade that is not stored yet, however late it comes.

    No watermark: repeats are dropped inside a micro-batch, then against the stored rows.
    A repeated trade has the same time, so only the batch's own weeks are read (the folders
    are ``week=``), however far apart they lie. Nothing is overwritten: a repeated batch, or a new checkpoint on the same
    path, finds its rows stored and appends what is missing. One writer for each path.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch = with_week(batch.dropDuplicates(keys), time)
        batch.persist()
        try:
            weeks = [r["week"] for r in batch.select("week").distinct().collect()]
            if weeks:
                stored = _stored(batch, path)
                if stored is not None:
                    near = F.col("week").isin([w for w in weeks if w is not None])
                    batch = new_rows(batch, stored.filter(near | F.col("week").isNull() if None in weeks else near), keys)
                batch.write.mode("append").partitionBy("week").parquet(path)
        finally:
            batch.unpersist()

    return _start(trades, write, checkpoint, available_now)


def _start(df: DataFrame, write, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = df.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now
            else writer.trigger(processingTime="60 seconds")).start()


def _stored(batch: DataFrame, path: str) -> DataFrame | None:
    """The table written so far, None before the first batch."""
    try:
        return batch.sparkSession.read.schema(batch.schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _batch_name(spark: SparkSession, checkpoint: str, batch_id: int) -> str:
    """A micro-batch of one checkpoint.

    The run is the query's id, which lives in the checkpoint: a restart repeats its own
    names, a new checkpoint on the same path never meets them.
    """
    return f"{json.loads(spark.read.text(f'{checkpoint}/metadata').first()[0])['id']}/{batch_id}"


def start_catalog_log(sightings: DataFrame, path: str, checkpoint: str, *,
                      available_now: bool = False) -> StreamingQuery:
    """Append every micro-batch of sightings to the log at ``path``, once.

    The rows carry the source's own ingest sequence. Small files are merged now and then.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        Log(batch.sparkSession, path).append(batch, _batch_name(batch.sparkSession, checkpoint, batch_id))

    return _start(sightings, write, checkpoint, available_now)


def current_catalog(log: DataFrame, keys: list[str], columns: list[str], seen: str, order: list[str],
                    raw: str | None = None) -> DataFrame:
    """The catalog as of the whole log: newest non-NULL values, first and last sighting."""
    return coalesce_merge(log, keys, order, columns, seen=seen, raw=raw)


def start_bucket_log(rows: DataFrame, path: str, checkpoint: str, keys: list[str], values: list[str], *, width: int,
                     order: list[str], time: str = "ts", available_now: bool = False) -> StreamingQuery:
    """Last values per key and time bucket of every micro-batch (``width`` in the unit of ``time``).

    Each batch adds one row for each bucket it touches, late rows included;
    :func:`current_buckets` merges them, and so does the log when it makes a new base.
    ``order`` is unique within a key.
    """
    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys, "bucket_ts").agg(F.max_by("last", "at").alias("last"), F.max("at").alias("at"))

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = (batch.withColumn("bucket_ts", F.floor(F.col(time) / width) * width).groupBy(*keys, "bucket_ts")
                .agg(F.max(F.struct(*order)).alias("at"), F.max_by(F.struct(*values), F.struct(*order)).alias("last")))
        Log(batch.sparkSession, path, merge).append(rows, _batch_name(batch.sparkSession, checkpoint, batch_id))

    return _start(rows, write, checkpoint, available_now)


def current_buckets(log: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Every bucket with its last values, as of the whole log."""
    return (log.groupBy(*keys, "bucket_ts").agg(F.max_by("last", "at").alias("last"))
            .select(*keys, F.col("bucket_ts").cast("bigint").alias("bucket_ts"), *[F.col(f"last.{v}").alias(v) for v in values]))


def stream_flag_halted(polls: DataFrame, markets: DataFrame, keys: list[str], market: list[str], *,
                       time: str = "ts", active: str = "active", start: str = "game_start_ts") -> DataFrame:
    """Markets near their start while a poll says trading is halted.

    A stream-static join on (key, dyadic node): a watch window is covered by a few nodes of
    low levels, and a poll lies in one node of each, so polls never meet all markets. Feed the
    result to ``set_fields``.
    """
    g = F.col(start)
    spread = (markets.filter(g.isNotNull() & (g != 0)).select(*dict.fromkeys([*keys, *market, start]))
              .withColumn("__n", F.explode(dyadic_cover(g - WATCH_BEFORE, g + WATCH_AFTER)))
              .withColumn("__level", F.col("__n.level")).withColumn("__node", F.col("__n.node")).drop("__n"))
    # No node of a cover is wider than the window.
    top = max(0, (WATCH_BEFORE + WATCH_AFTER).bit_length() - BASE_BITS)
    halted = (polls.filter(~F.col(active)).select(*keys, F.col(time).alias("__t"))
              .withColumn("__level", F.explode(F.sequence(F.lit(0), F.lit(top))))
              .withColumn("__node", dyadic_node(F.col("__t"), F.col("__level"))))
    near = F.col("__t").between(g - WATCH_BEFORE, g + WATCH_AFTER)
    return halted.join(spread, [*keys, "__level", "__node"]).filter(near).select(*dict.fromkeys([*keys, *market]), "__t")
