"""Per-market time series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import TRADE_OVERLAP
from ..functions.numbers import best_mid, sql_round
from .ordered import ROWS_PER_SEGMENT, find_cuts, neighbour


def distinct_on(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row per key by an order that does not tie."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def finest_series(points: DataFrame, keys: list[str], time: str, order: list[str],
                  price: str, skip_null: bool = False) -> DataFrame:
    """One price per (key, time): the finest resolution, NULL prices removed afterwards.

    With ``skip_null`` a NULL fine price lets the next coarser one through.
    """
    if skip_null:
        points = points.filter(F.col(price).isNotNull())
    return (distinct_on(points, [*keys, time], order)
            .select(*keys, time, price).filter(F.col(price).isNotNull()))


def mid_series(books: DataFrame, keys: list[str], time: str, bids: str = "bids",
               asks: str = "asks") -> DataFrame:
    """Middle of best bid and best ask; books with an empty side are dropped."""
    return (books.select(*keys, time, best_mid(F.col(bids), F.col(asks)).alias("price"))
            .filter(F.col("price").isNotNull()))


def mid_price(bid: Column, ask: Column) -> Column:
    return sql_round((bid + ask) / 2, 4)


def trade_series(trades: DataFrame, keys: list[str], time: str, price: str) -> DataFrame:
    """Trade prices in time order per market, NULL prices dropped; markets come in no order."""
    return (trades.select(*keys, time, price).filter(F.col(price).isNotNull())
            .repartition(*keys).sortWithinPartitions(*keys, time))


def change_only(df: DataFrame, keys: list[str], order: list[str], value: str,
                rows_per_segment: int | None = ROWS_PER_SEGMENT) -> DataFrame:
    """Rows whose value differs from the previous row of the key (the first is kept)."""
    cuts = find_cuts(df, keys, order, rows_per_segment)
    seen = neighbour(df, keys, order, value, "__prev", cuts=cuts, found="__has")
    return (seen.filter(~F.col("__has") | ~F.col(value).eqNullSafe(F.col("__prev")))
            .drop("__prev", "__has"))


def latest_per_key(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Values of the newest row per key."""
    newest = F.struct(*order) if len(order) > 1 else F.col(order[0])
    return df.groupBy(*keys).agg(*[F.max_by(v, newest).alias(v) for v in values])


def newest_trade_mark(trades: DataFrame, keys: list[str], time: str, mark: str = "last_trade_ts",
                      cutoff: str = "cutoff_ts", overlap: int = TRADE_OVERLAP) -> DataFrame:
    """Newest trade time per market and the re-read cutoff ``max(0, mark - overlap)``.

    ``time`` is in unix seconds.
    """
    return (trades.groupBy(*keys).agg(F.max(time).alias(mark))
            .withColumn(cutoff, F.greatest(F.lit(0).cast("bigint"), F.col(mark) - overlap)))


def bucket_last(df: DataFrame, keys: list[str], time: str, width_seconds: int,
                values: list[str], bucket: str = "bucket_ts", seq: str | None = None) -> DataFrame:
    """Last values in each time bucket (bucket start in unix seconds).

    ``time`` is in microseconds; ``seq`` orders rows of one instant.
    """
    order = F.struct(time, seq) if seq else F.col(time)
    width = width_seconds * 1_000_000
    start = F.floor(F.col(time) / width) * width_seconds
    return (df.withColumn(bucket, start.cast("bigint"))
            .groupBy(*keys, bucket).agg(*[F.max_by(v, order).alias(v) for v in values]))


def series_choice(prices: DataFrame, mids: DataFrame, trades: DataFrame, keys: list[str],
                  time: str = "ts", price: str = "price") -> DataFrame:
    """Price and midpoint series where present; trades only for markets with neither."""
    cols = [*keys, time, price]
    shown = (prices.select(*cols).withColumn("kind", F.lit("price"))
             .unionByName(mids.select(*cols).withColumn("kind", F.lit("mid"))))
    rest = trades.select(*cols).join(shown.select(*keys).distinct(), keys, "left_anti")
    return shown.unionByName(rest.withColumn("kind", F.lit("trades")).select(*cols, "kind"))
