"""Market catalog: search, coverage, status and watch tiers."""

from __future__ import annotations

import datetime as dt
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (OPEN_STATUSES, PLATFORMS, TICKER_OPEN_STATUSES, TICKER_PLATFORM,
                         TOKEN_OPEN_STATUSES, TOKEN_PLATFORM, WATCH_AFTER, WATCH_BEFORE)
from ..functions.texts import contains_ci
from .intervals import interval_overlap

_DATE = re.compile(r"^\d{4}-\d{2}-\d{2}$")


def term_filter(term: str, text_columns: list[str], start: str, literal: bool = True) -> Column:
    """One search term: a UTC day (both midnights included) or text in any of the columns."""
    if _DATE.match(term):
        day = int(dt.datetime.strptime(term, "%Y-%m-%d").replace(tzinfo=dt.timezone.utc).timestamp())
        return F.col(start).between(day, day + 86400)
    return reduce(lambda a, b: a | b, [contains_ci(F.col(c), term, literal) for c in text_columns])


def search_games(markets: DataFrame, terms: list[str], *, limit: int = 100,
                 literal: bool = True) -> DataFrame:
    """Events with a market matching all terms, latest start first.

    ``n_markets`` counts the matching markets only.
    """
    hits = markets.filter(F.col("event_id").isNotNull())
    for term in terms:
        hits = hits.filter(term_filter(term, ["event_id", "title", "outcome"], "game_start_ts", literal))
    return (hits.groupBy("platform", "event_id")
            .agg(F.count(F.lit(1)).alias("n_markets"),
                 F.min("game_start_ts").alias("game_start_ts"),
                 F.min("title").alias("sample_title"),
                 F.max("outage_affected").alias("outage_affected"))
            .orderBy(F.col("game_start_ts").desc_nulls_last(), "platform", "event_id")
            .limit(limit))


def coverage(markets: DataFrame, series: dict[str, DataFrame], keys: list[str] | None = None,
             event: list[str] | None = None) -> DataFrame:
    """Stored rows per event in each series table, over all markets of the event.

    Each table is counted per market first, so only counts are joined.
    """
    keys = keys or ["platform", "market_id"]
    return coverage_of_counts(markets, {name: table.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")) for name, table in series.items()}, keys, event)


def coverage_of_counts(markets: DataFrame, counts: dict[str, DataFrame], keys: list[str] | None = None,
                       event: list[str] | None = None) -> DataFrame:
    """The same from one row count ``n`` per market, as a rollup keeps it."""
    keys = keys or ["platform", "market_id"]
    event = event or ["platform", "event_id"]
    members = markets.filter(F.col(event[-1]).isNotNull()).select(*dict.fromkeys([*keys, *event]))
    for name, table in counts.items():
        members = members.join(table.select(*keys, F.col("n").alias(name)), keys, "left")
    return (members.groupBy(*event)
            .agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias(n) for n in counts]))


def search_with_coverage(markets: DataFrame, series: dict[str, DataFrame], terms: list[str], *,
                         limit: int = 100, literal: bool = True) -> DataFrame:
    """Search results with their coverage; series are reduced to the found events' markets."""
    found = search_games(markets, terms, limit=limit, literal=literal)
    members = markets.join(found.select("platform", "event_id"), ["platform", "event_id"], "left_semi")
    keys = members.select("platform", "market_id").distinct()
    cov = coverage(members, {name: table.join(keys, ["platform", "market_id"], "left_semi") for name, table in series.items()})
    return found.join(cov, ["platform", "event_id"], "left")


def ilike_any(df: DataFrame, column: str, names: str, literal: bool = True) -> DataFrame:
    """Rows whose column contains any of the comma-separated names.

    No name lets every non-NULL value pass; NULL never passes.
    """
    wanted = [n.strip() for n in names.split(",") if n.strip()]
    if not wanted:
        return df.filter(F.col(column).isNotNull())
    return df.filter(reduce(lambda a, b: a | b, [contains_ci(F.col(column), n, literal) for n in wanted]))


def open_markets(markets: DataFrame) -> DataFrame:
    return markets.filter(
        ((F.col("platform") == TOKEN_PLATFORM) & F.col("status").isin(*TOKEN_OPEN_STATUSES))
        | ((F.col("platform") == TICKER_PLATFORM) & F.col("status").isin(*TICKER_OPEN_STATUSES)))


def with_tier(df: DataFrame, now: int, start: str = "game_start_ts") -> DataFrame:
    """Tier ``fast`` from 45 minutes before to 8 hours after the start, else ``slow``."""
    g = F.when(F.col(start) != 0, F.col(start))
    near = F.lit(now).between(g - WATCH_BEFORE, g + WATCH_AFTER)
    return df.withColumn("tier", F.when(near, "fast").otherwise("slow"))


def watch_tiers(markets: DataFrame, now: int) -> DataFrame:
    return with_tier(open_markets(markets), now)


def event_members(series: DataFrame, markets: DataFrame, events: DataFrame,
                  keys: list[str] | None = None, event: list[str] | None = None) -> DataFrame:
    """Rows of a series table whose market belongs to one of the events."""
    keys = keys or ["platform", "market_id"]
    event = event or ["platform", "event_id"]
    members = markets.join(events.select(*event), event, "left_semi").select(*keys)
    return series.join(members, keys, "left_semi")


def inner_catalog(series: DataFrame, markets: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Series rows with catalog columns; small catalogs are broadcast by the planner."""
    return series.join(markets.select(*keys, *columns), keys)


def platform_status(markets: DataFrame, books: DataFrame, trades: DataFrame,
                    platforms: tuple = PLATFORMS, group: str = "platform",
                    latest: Column | None = None) -> DataFrame:
    """Per platform: markets, open and backfilled ones, snapshots, newest snapshot, trades.

    All platforms appear. ``latest`` is the snapshot time expression (default: ms of ``ts``).
    """
    spark = markets.sparkSession
    latest = F.unix_millis(F.col("ts")) if latest is None else latest
    m = markets.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_markets"),
        F.sum(F.when(F.col("status").isin(*OPEN_STATUSES), 1).otherwise(0)).alias("n_open"),
        F.sum("backfilled").alias("n_backfilled"))
    s = books.groupBy(group).agg(F.count(F.lit(1)).alias("n_snapshots"), F.max(latest).alias("latest_ms"))
    t = trades.groupBy(group).agg(F.count(F.lit(1)).alias("n_trades"))
    names = spark.range(1).select(F.explode(F.array(*[F.lit(p) for p in platforms])).alias(group))
    res = names.join(m, group, "left").join(s, group, "left").join(t, group, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return res.select(group, zero("n_markets"), zero("n_open"), zero("n_backfilled"),
                      zero("n_snapshots"), "latest_ms", zero("n_trades"))


def event_markets(markets: DataFrame, trades: DataFrame,
                  keys: list[str] | None = None, event: list[str] | None = None) -> DataFrame:
    """Markets of every event with their trade count and the event's earliest start.

    Sorted inside each event by trades descending, then market.
    """
    keys = keys or ["platform", "market_id"]
    event = event or ["platform", "event_id"]
    counts = trades.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_trades"))
    start = markets.groupBy(*event).agg(
        F.min(F.when(F.col("game_start_ts") != 0, F.col("game_start_ts"))).alias("event_start_ts"))
    return (markets.join(counts, keys, "left").withColumn("n_trades", F.coalesce("n_trades", F.lit(0)))
            .join(start, event, "left")
            # Order is asked for inside an event only, so no task sorts all of them.
            .repartition(*event).sortWithinPartitions(*event, F.col("n_trades").desc(), keys[-1]))


def event_outages(markets: DataFrame, outages: DataFrame, now: int) -> DataFrame:
    """Outages overlapping each event's window."""
    starts = (markets.filter(F.col("event_id").isNotNull()).groupBy("platform", "event_id")
              .agg(F.min(F.when(F.col("game_start_ts") != 0, F.col("game_start_ts")))
                   .alias("game_start_ts")))
    return interval_overlap(starts, outages, ["platform"], "game_start_ts", now)
