"""Export everything stored about events as CSV, all events in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import WATCH_AFTER, WATCH_BEFORE
from ..functions.texts import safe_name
from ..functions.times import epoch_millis, epoch_seconds
from ..operators.intervals import interval_overlap


def _json_levels(col: str) -> Column:
    """``[[price, size], ...]`` as text."""
    return F.to_json(F.transform(F.col(col), lambda x: F.array(x["price"], x["size"])))


def export_views(tables: dict[str, DataFrame]) -> dict[str, tuple[DataFrame, list[str]]]:
    """Exported columns and row order of each table."""
    seconds = epoch_seconds(F.col("ts")).alias("ts")
    key = ["platform", "market_id"]
    return {
        "markets": (tables["markets"].select(
            *key, "event_id", "series", "condition_id", "title", "outcome", "game_start_ts", "open_ts",
            "close_ts", "status", "result", "outage_affected"), ["market_id"]),
        "book_snapshots": (tables["book_snapshots"].select(
            *key, epoch_millis(F.col("ts")).alias("ts_ms"), epoch_millis(F.col("source_ts")).alias("source_ts_ms"),
            _json_levels("bids").alias("bids"), _json_levels("asks").alias("asks")), ["market_id", "ts_ms"]),
        "trades": (tables["trades"].select(*key, "trade_id", seconds, "price", "size", "side"),
                   ["market_id", "ts"]),
        "candles": (tables["candles"].select(
            *key, "period_min", seconds, "open", "high", "low", "close", "volume", "open_interest"),
            ["market_id", "period_min", "ts"]),
        "price_points": (tables["price_points"].select(*key, "fidelity", seconds, "price"),
                         ["market_id", "fidelity", "ts"]),
    }


def event_folder(platform: Column, event_id: Column) -> Column:
    """Directory of an event: its safe name and a short hash, so that no two events share one."""
    return F.concat(safe_name(F.concat_ws("_", platform, event_id)), F.lit("-"),
                    F.substring(F.md5(F.concat_ws("\n", platform, event_id)), 1, 8))


def export_rows(tables: dict[str, DataFrame], events: DataFrame, now: int) -> dict[str, tuple[DataFrame, list[str]]]:
    """Rows to export per table with their event (``dir`` names the directory) and order."""
    members = (tables["markets"].join(events.select("platform", "event_id").distinct(),
                                      ["platform", "event_id"], "left_semi"))
    folder = event_folder(F.col("platform"), F.col("event_id")).alias("dir")
    link = members.select("platform", "market_id", folder)
    out = {}
    for name, (view, order) in export_views(tables).items():
        out[name] = (view.join(link, ["platform", "market_id"]), order)
    # A start of 0 is unknown: it does not hide the event's known starts.
    starts = (members.filter(F.col("game_start_ts") != 0).groupBy("platform", "event_id")
              .agg(F.min("game_start_ts").alias("game_start_ts")).withColumn("dir", folder))
    outages = interval_overlap(starts, tables["outages"], ["platform"], "game_start_ts", now,
                               before=WATCH_BEFORE, after=WATCH_AFTER)
    out["outages"] = (outages.select("platform", "kind", "start_ts", "end_ts", "note", "dir"), ["start_ts"])
    return out


def export_events(tables: dict[str, DataFrame], events: DataFrame, path: str, now: int) -> list[str]:
    """Write ``<path>/<table>/dir=<platform_event>/*.csv`` with headers for all events.

    Rows are range-partitioned by (event, order): an event's files follow the sort
    order by name, and a large event is split over several files. A table without
    rows for an event gets no directory. Returns the table paths.
    """
    written = []
    for name, (rows, order) in export_rows(tables, events, now).items():
        target = f"{path.rstrip('/')}/{name}"
        (rows.repartitionByRange("dir", *order).sortWithinPartitions("dir", *order)
         .write.mode("overwrite").option("header", True).partitionBy("dir").csv(target))
        written.append(target)
    return written

