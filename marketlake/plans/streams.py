"""The streaming operators over the event files, each checked against its batch twin's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.times import micros
from ..session import scratch_path
from ..sinks.log import Log
from ..streaming.keyed import halt_table, stream_change_only, stream_halts
from ..streaming.native import (current_buckets, current_catalog, start_bucket_log, start_catalog_log, start_trade_sink,
                                stream_flag_halted)
from ..streaming.run import drain
from .registry import SQL, query


def _files(rows) -> int:
    """Files of a micro-batch: as many as tasks read the table, so that they grow with it."""
    return max(1, rows.rdd.getNumPartitions())


def _events(t, order=(0, 1, 2, 3, 4)):
    """The events as a stream of five micro-batches: quarters of their time in the given order.

    Every fiftieth user reports late: its events come with the quarter after.
    """
    e = t("events")
    path = scratch_path(t.spark, "landing")
    e = e.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("t", micros(F.col("ts")))
    edges = e.approxQuantile("t", [0.25, 0.5, 0.75], 0.01)
    quarter = sum((F.col("t") > x).cast("int") for x in edges) + (F.col("user_id") % 50 == 7).cast("int")
    files = _files(e)
    for piece in order:
        e.filter(quarter == piece).repartition(files).write.mode("append").parquet(path)
    stream = t.spark.readStream.schema(e.schema).option("maxFilesPerTrigger", files).parquet(path)
    return stream.withColumn("s", F.floor(F.col("t") / 1_000_000).cast("bigint"))


def _jumbled(t):
    """The events as a stream of five micro-batches by their time plus a delay of up to ten minutes.

    A last row without an id, two hours later, moves the watermark past all of them.
    """
    e = t("events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("t", micros(F.col("ts"))).select("event_id", "user_id", "t", "event_type")
    path = scratch_path(t.spark, "landing")
    e = e.withColumn("arrival", F.col("t") + F.pmod(F.xxhash64("event_id"), F.lit(599_000_000)))
    edges = e.approxQuantile("arrival", [0.2, 0.4, 0.6, 0.8], 0.01)
    part = sum((F.col("arrival") > x).cast("int") for x in edges)
    files = _files(e)
    for piece in range(5):
        e.filter(part == piece).drop("arrival").repartition(files).write.mode("append").parquet(path)
    end = e.agg((F.max("t") + 7_200_000_000).alias("t")).select(
        F.lit(None).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("user_id"), "t", F.lit("end").alias("event_type"))
    end.write.mode("append").parquet(path)
    return t.spark.readStream.schema(e.drop("arrival").schema).option("maxFilesPerTrigger", files).parquet(path)


#: Where the order of arrival must not matter.
SHUFFLED = (2, 4, 0, 3, 1)


@query("change_stream", SQL["change_only"])
def change_stream(t):
    """Change-only snapshots, although events arrive out of order by up to ten minutes."""
    books = _jumbled(t).select("event_id", "user_id", "t", F.sha1("event_type").alias("hash"))
    kept = drain(stream_change_only(books, ["user_id"], ["t", "event_id"], "hash"), "change")
    return kept.filter(~F.col("late") & F.col("event_id").isNotNull()).select("event_id", "user_id", "hash")


@query("halts_stream", SQL["halts"])
def halts_stream(t):
    """Halts with the open start of every user as state."""
    polls = _events(t).select("user_id", "t", "event_id", (F.col("event_type") != "error").alias("active"))
    events = drain(stream_halts(polls, ["user_id"], "t", "active", "event_id"), "halts")
    return (halt_table(events, ["user_id"])
            .select("user_id", F.col("start_ts").alias("start_us"), F.col("end_ts").alias("end_us")))


@query("trade_stream", "SELECT event_id, user_id, epoch_us(ts) AS t, value FROM events")
def trade_stream(t):
    """Every event read twice, as overlapping polls do, in two jobs with checkpoints of their own."""
    path = scratch_path(t.spark, "trades")
    for job, order in enumerate((SHUFFLED, (0, 1, 2, 3, 4))):
        trades = _events(t, order).select("event_id", "user_id", "ts", "t", "value")
        start_trade_sink(trades, f"{path}/out", f"{path}/checkpoint{job}", ["event_id"], available_now=True).awaitTermination()
    return t.spark.read.parquet(f"{path}/out").select("event_id", "user_id", "t", "value")


@query("catalog_stream", SQL["catalog_merge"])
def catalog_stream(t):
    """Sightings appended batch by batch, then the current catalog."""
    log = _events(t, SHUFFLED).select(
        "user_id", "t", "event_id", "event_type", F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
        F.when(F.col("event_type") == "signup", F.col("props")).alias("props"))
    path = scratch_path(t.spark, "catalog")
    start_catalog_log(log, f"{path}/log", f"{path}/checkpoint", available_now=True).awaitTermination()
    return current_catalog(Log(t.spark, f"{path}/log").read(), ["user_id"], ["value", "event_type", "props"], "t",
                           raw="props", order=["t", "event_id"])


@query("bucket_stream", SQL["bucket_last"])
def bucket_stream(t):
    """Hourly last values and kinds of all events, late ones included."""
    rows = _events(t, SHUFFLED).withColumn("hour", F.col("s"))
    path = scratch_path(t.spark, "buckets")
    start_bucket_log(rows, f"{path}/log", f"{path}/checkpoint", ["user_id"], ["value", "event_type"], width=3600, time="hour",
                     order=["t", "event_id"], available_now=True).awaitTermination()
    return current_buckets(Log(t.spark, f"{path}/log").read(), ["user_id"], ["value", "event_type"])


@query("flag_stream", """
SELECT DISTINCT p.event_id, p.user_id FROM events p JOIN events e ON p.user_id = e.user_id
WHERE p.event_type = 'purchase' AND e.event_type = 'error'
  AND floor(epoch_us(e.ts) / 1e6) BETWEEN floor(epoch_us(p.ts) / 1e6) - 2700 AND floor(epoch_us(p.ts) / 1e6) + 28800""")
def flag_stream(t):
    """Purchases near which a halted poll was seen."""
    polls = _events(t).select("user_id", F.col("s").alias("ts"), (F.col("event_type") != "error").alias("active"))
    games = t.events("purchase").select("event_id", "user_id", F.col("s").alias("game_start_ts"))
    hits = drain(stream_flag_halted(polls, games, ["user_id"], ["event_id"]), "flags")
    return hits.select("event_id", "user_id").distinct()
