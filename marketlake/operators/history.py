"""Which history a market needs: worklist, windows, request chunks, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (FINE_BEFORE, FIRST_MONTH, LATE_FINE, LEAD_IN, LONG_LIVED,
                         MONTH_HORIZON_DAYS, TICKER_CHUNK_PERIODS, TICKER_PLATFORM,
                         TICKER_SETTLED_STATUSES, TOKEN_CHUNK, TOKEN_PLATFORM,
                         TOKEN_TERMINAL_STATUSES, TRADE_TAIL, WATCH_AFTER)
from ..functions.numbers import to_double


def market_volume(raw: Column) -> Column:
    """Reported lifetime volume: the first readable of three fields, NULL when unknown."""
    return F.coalesce(*[to_double(F.get_json_object(raw, f"$.{k}"))
                        for k in ("volumeNum", "volume", "volume_fp")])


def pending(markets: DataFrame) -> DataFrame:
    """Terminal markets whose history was not captured yet."""
    terminal = (((F.col("platform") == TOKEN_PLATFORM) & F.col("status").isin(*TOKEN_TERMINAL_STATUSES))
                | ((F.col("platform") == TICKER_PLATFORM) & F.col("status").isin(*TICKER_SETTLED_STATUSES)))
    return markets.filter((F.col("backfilled") == 0) & terminal)


def with_task(markets: DataFrame) -> DataFrame:
    """Pending markets with their volume and task: tokens of one condition share a task,
    a ticker is its own."""
    task = F.when(F.col("platform") == TOKEN_PLATFORM,
                  F.coalesce(F.when(F.col("condition_id") != "", F.col("condition_id")),
                             F.col("market_id"))).otherwise(F.col("market_id"))
    return (pending(markets)
            .select("platform", "market_id", "event_id", "series", "condition_id", "game_start_ts",
                    "open_ts", "close_ts", market_volume(F.col("raw")).alias("volume"))
            .withColumn("task", task))


def backfill_worklist(markets: DataFrame, limit: int | None = None) -> DataFrame:
    """Pending markets, latest close first (unknown closes lead)."""
    todo = with_task(markets).orderBy(F.col("close_ts").desc_nulls_first(), "platform", "market_id")
    return todo.limit(limit) if limit else todo


def _task_volume() -> list[Column]:
    return [F.sum("volume").alias("known_volume"),
            F.sum(F.when(F.col("volume").isNull(), 1).otherwise(0)).alias("n_unknown")]


def worklist_tasks(worklist: DataFrame) -> DataFrame:
    """One row per task: members, known volume, and whether history can be skipped.

    A task needs no history when the volumes of all its members are known to be 0.
    Counts and sums only, so a task with many members is combined map-side.
    """
    return (worklist.groupBy("platform", "task")
            .agg(F.count(F.lit(1)).alias("n_markets"), *_task_volume(), F.max("close_ts").alias("close_ts"))
            .withColumn("skip", (F.col("n_unknown") == 0) & (F.col("known_volume") == 0)))


def history_window(df: DataFrame, now: int, last_trade: str | None = "last_trade_ts") -> DataFrame:
    """Add ``start_ts`` and ``end_ts`` bounds of the history a market can have."""
    def given(c):
        return F.when(F.col(c) != 0, F.col(c))

    at = F.lit(now).cast("bigint")
    start = F.coalesce(given("open_ts"), F.coalesce(given("game_start_ts"), at) - LEAD_IN)
    end = F.least(F.coalesce(given("close_ts"), at), at)
    if last_trade:
        end = F.least(end, given(last_trade) + TRADE_TAIL)  # least skips NULL
    return (df.withColumn("end_ts", end.cast("bigint"))
            .withColumn("start_ts", F.least(start, F.col("end_ts")).cast("bigint")))


def _tier(resolution: int, start: Column, end: Column, step: int, when: Column | None = None) -> Column:
    row = F.struct(F.lit(resolution).alias("resolution"), start.cast("bigint").alias("t0"),
                   end.cast("bigint").alias("t1"), F.lit(step).cast("bigint").alias("step"))
    return row if when is None else F.when(when, row)


def window_tiers(windows: DataFrame) -> DataFrame:
    """Resolutions (minutes) to fetch over which part of each window.

    Tokens: 10-minute prices over the life (its last 21 days if longer) and
    1-minute prices around the start. Tickers: 1-minute candles over a life of up
    to 21 days, else 60-minute candles plus 1-minute ones over the last 3 days;
    none for a known volume of exactly 0.
    """
    s, e, g = F.col("start_ts"), F.col("end_ts"), F.when(F.col("game_start_ts") != 0, F.col("game_start_ts"))
    token = F.col("platform") == TOKEN_PLATFORM
    traded = ~F.coalesce(F.col("volume") == 0, F.lit(False))
    long_lived = (e - s) > LONG_LIVED
    per = TICKER_CHUNK_PERIODS * 60
    tiers = F.array(
        _tier(10, F.when(long_lived, F.greatest(s, e - LONG_LIVED)).otherwise(s), e, TOKEN_CHUNK[10],
              token & traded),
        _tier(1, F.greatest(s, g - FINE_BEFORE), F.least(e, g + WATCH_AFTER), TOKEN_CHUNK[1],
              token & traded & g.isNotNull()),
        _tier(1, s, e, per, ~token & traded & ~long_lived),
        _tier(60, s, e, 60 * per, ~token & traded & long_lived),
        _tier(1, F.greatest(s, e - LATE_FINE), e, per, ~token & traded & long_lived))
    keep = [c for c in windows.columns if c not in ("resolution", "t0", "t1", "step")]
    return (windows.withColumn("__tier", F.explode(F.filter(tiers, lambda t: t.isNotNull())))
            .select(*keep, "__tier.*"))


def history_chunks(markets: DataFrame, trades: DataFrame, now: int) -> DataFrame:
    """Request chunks of every pending market, from catalog and stored trades.

    A token's window ends a day after its own last trade, else after the last trade
    of its condition; a task's volume counts for all its members.
    """
    marks = (trades.groupBy("platform", "market_id")
             .agg(F.max(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("own_last")))
    known = with_task(markets).join(marks, ["platform", "market_id"], "left")
    tasks = known.groupBy("platform", "task").agg(*_task_volume(), F.max("own_last").alias("task_last"))
    ready = (known.drop("volume").join(tasks, ["platform", "task"])
             .withColumn("volume", F.when(F.col("n_unknown") == 0, F.col("known_volume")))
             .withColumn("last_trade_ts", F.coalesce("own_last", "task_last")))
    return (chunk_expand(window_tiers(history_window(ready, now)))
            .select("platform", "market_id", "task", "resolution", "chunk_start", "chunk_end"))


def chunk_expand(tiers: DataFrame, t0: str = "t0", t1: str = "t1", step: str = "step") -> DataFrame:
    """Cut [t0, t1) into consecutive chunks; an empty or reversed span gives none."""
    return (tiers.filter(F.col(t0) < F.col(t1))
            .withColumn("chunk_start", F.explode(F.sequence(F.col(t0), F.col(t1) - 1, F.col(step))))
            .withColumn("chunk_end", F.least(F.col("chunk_start") + F.col(step), F.col(t1))))


def month_windows(df: DataFrame, first: Column | str = FIRST_MONTH, now: Column | None = None,
                  days: int = MONTH_HORIZON_DAYS) -> DataFrame:
    """Calendar months from ``first`` until ``days`` after ``now``, one row per month.

    ``df`` carries the dates (one row per range).
    """
    first = F.lit(first) if isinstance(first, str) else first
    start = F.trunc(F.to_date(first), "month")
    now = F.current_timestamp() if now is None else now
    # The month that begins exactly at the horizon is not included.
    last = F.to_date(F.date_sub(F.to_date(now), 0) + F.make_interval(days=F.lit(days)))
    at_midnight = now.cast("timestamp") == F.to_date(now).cast("timestamp")
    upper = F.when(at_midnight, F.date_sub(last, 1)).otherwise(last)
    return (df.withColumn("month_start", F.explode(F.when(
                start <= upper, F.sequence(start, upper, F.expr("INTERVAL 1 MONTH")))))
            .withColumn("month_end", F.add_months("month_start", 1)))


def coverage_gaps(chunks: DataFrame, stored: DataFrame, keys: list[str], time: str,
                  step: int) -> DataFrame:
    """Chunks of ``step`` seconds (starting at multiples of it) without a stored point.

    Chunk and point meet on the same grid cell, so this is an equi anti join on
    cells reduced to one row each.
    """
    cells = (stored.select(*keys, (F.floor(F.col(time) / step) * step).cast("bigint").alias("chunk_start"))
             .distinct())
    return chunks.join(cells, [*keys, "chunk_start"], "left_anti").select(*chunks.columns)


def range_gaps(chunks: DataFrame, stored: DataFrame, keys: list[str], time: str,
               rows_per_segment: int | None = None) -> DataFrame:
    """Chunks [chunk_start, chunk_end) of any alignment without a stored point.

    The last point before a chunk's end decides, found with an as-of join.
    """
    from .asof import asof_backward

    probes = chunks.withColumn("__last", F.col("chunk_end") - 1)
    extra = {} if rows_per_segment is None else {"rows_per_segment": rows_per_segment}
    points = stored.select(*keys, F.col(time).cast("bigint").alias("__at"))
    seen = asof_backward(probes, points, keys, "__last", "__at", [], at="__point", **extra)
    return (seen.filter(F.col("__point").isNull() | (F.col("__point") < F.col("chunk_start")))
            .select(*chunks.columns))
