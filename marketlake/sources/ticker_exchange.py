"""Landing records of the ticker exchange: markets, books, trades, candles and status as raw JSON.

Each document is parsed once: into the members used, or into a VARIANT where the
type of a number or the presence of a key decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import TICKER_PLATFORM
from ..functions.numbers import json_given, json_member, json_plain, json_price, to_double
from ..functions.times import from_seconds, parse_ts, ticker_start
from .token_exchange import with_sides

_MARKET = ("struct<ticker:string,event_ticker:string,occurrence_datetime:string,expected_expiration_time:string,"
           "title:string,yes_sub_title:string,open_time:string,close_time:string,status:string,result:string>")
_PAIRS = "array<array<string>>"
_SIDES = f"struct<yes_dollars:{_PAIRS},yes:{_PAIRS},no_dollars:{_PAIRS},no:{_PAIRS}>"
_BOOK = f"struct<orderbook_fp:{_SIDES},orderbook:{_SIDES}>"
_STATUS = ("struct<exchange_active:boolean,trading_active:boolean,exchange_index_statuses:array<struct<"
           "exchange_index:int,trading_active:boolean,exchange_active:boolean>>>")
_SCHEDULE = "struct<schedule:struct<maintenance_windows:array<string>>>"
_WINDOW = "struct<start_datetime:string,start_time:string,end_datetime:string,end_time:string>"


def _nonzero(ts: Column) -> Column:
    return F.when(ts != 0, ts)


def _given(text: Column) -> Column:
    return F.when(text != "", text)


def normalize_ticker_markets(markets: DataFrame, value: str = "value", series: str = "series") -> DataFrame:
    """One row per ticker; ``series`` is a column beside the document."""
    d = F.col("d")
    parsed = markets.select(F.col(series).alias("series"), F.col(value).alias("raw"),
                            F.from_json(value, _MARKET).alias("d"))
    start = F.coalesce(_nonzero(ticker_start(F.coalesce(_given(d["event_ticker"]), d["ticker"]))),
                       _nonzero(parse_ts(d["occurrence_datetime"])), parse_ts(d["expected_expiration_time"]))
    return parsed.select(
        F.lit(TICKER_PLATFORM).alias("platform"), d["ticker"].alias("market_id"),
        d["event_ticker"].alias("event_id"), "series", F.lit(None).cast("string").alias("condition_id"),
        d["title"].alias("title"), d["yes_sub_title"].alias("outcome"), start.alias("game_start_ts"),
        parse_ts(d["open_time"]).alias("open_ts"), parse_ts(d["close_time"]).alias("close_ts"),
        d["status"].alias("status"), d["result"].alias("result"), "raw")


def _levels(pairs: Column, unit: float) -> Column:
    return F.transform(pairs, lambda x: F.struct((to_double(F.get(x, F.lit(0))) / unit).alias("price"),
                                                 to_double(F.get(x, F.lit(1))).alias("size")))


def normalize_books_yes_no(books: DataFrame, value: str = "value", market: str = "market_id",
                           capture: str = "capture_ts") -> DataFrame:
    """Books of resting YES and NO bids in YES terms: a NO bid at p is an ask at 1 - p.

    The unit of each side follows the list actually used: dollars, else cents.
    """
    b = F.col("b")
    fp = F.col("d.orderbook_fp")
    filled = (fp["yes_dollars"].isNotNull() | fp["yes"].isNotNull()
              | fp["no_dollars"].isNotNull() | fp["no"].isNotNull())
    rows = (books.select(F.lit(TICKER_PLATFORM).alias("platform"), F.col(market).alias("market_id"),
                         F.col(capture).alias("ts"), F.lit(None).cast("timestamp").alias("source_ts"),
                         F.from_json(value, _BOOK).alias("d"))
            .withColumn("b", F.when(filled, fp).otherwise(F.col("d.orderbook"))))

    def side(name):
        dollars = b[f"{name}_dollars"]
        return F.when(F.size(dollars) > 0, _levels(dollars, 1.0)).otherwise(_levels(b[name], 100.0))

    asks = F.transform(side("no"), lambda x: F.struct(F.round(1 - x["price"], 4).alias("price"), x["size"].alias("size")))
    return (with_sides(rows, side("yes"), asks)
            .select("platform", "market_id", "ts", "source_ts", "bids", "asks", "hash"))


def _text(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "string")


def normalize_ticker_trades(trades: DataFrame, value: str = "value", market: str = "market_id") -> DataFrame:
    """Trades with native ids; ``market`` is a column beside the document."""
    v = F.col("v")
    parsed = trades.select(F.col(market).alias("market_id"), F.col(value).alias("raw"),
                           F.try_parse_json(value).alias("v"))
    # Members are taken out once; the price rules below read each several times.
    parsed = parsed.select("market_id", "raw", _text(v, "trade_id").alias("trade_id"), _text(v, "created_time").alias("created"),
                           F.coalesce(_text(v, "taker_side"), F.lit("")).alias("side"),
                           *[json_member(v, f"$.{m}").alias(m) for m in ("yes_price_dollars", "yes_price", "count_fp", "count")])
    ts = F.coalesce(parse_ts(F.col("created")), F.lit(0).cast("bigint"))
    return parsed.select(
        F.lit(TICKER_PLATFORM).alias("platform"), "trade_id", "market_id", from_seconds(ts).alias("ts"),
        F.coalesce(json_price(F.col("yes_price_dollars")), json_price(F.col("yes_price"))).alias("price"),
        F.coalesce(json_plain(F.col("count_fp")), json_plain(F.col("count")), F.lit(0.0)).alias("size"), "side", "raw")


def _ohlc(v: Column, name: str) -> Column:
    """From the trade prices, else from the YES bid; in each the dollar key when it is there at all.

    A dollar key holding null passes on to the next source, not to the plain key beside it.
    """
    def of(source):
        # coalesce skips an absent key only: a variant null is a value.
        return F.coalesce(json_member(v, f"$.{source}.{name}_dollars"), json_member(v, f"$.{source}.{name}"))

    traded, bid = of("price"), of("yes_bid")
    return F.when(json_given(traded), json_price(traded)).otherwise(json_price(bid))


def normalize_candles(candles: DataFrame, value: str = "value", market: str = "market_id",
                      period: str = "period_min") -> DataFrame:
    """OHLC rows; ``market`` and ``period`` are columns beside the document. ts is the period's end."""
    v = F.col("v")
    parsed = candles.select(F.col(market).alias("market_id"), F.col(period).alias("period_min"),
                            F.col(value).alias("raw"), F.try_parse_json(value).alias("v"))

    def amount(name):
        fp, plain = json_member(v, f"$.{name}_fp"), json_member(v, f"$.{name}")
        return F.when(json_given(fp), json_plain(fp)).otherwise(F.coalesce(json_plain(plain), F.lit(0.0)))

    end = F.coalesce(_text(v, "end_period_ts").try_cast("bigint"), F.lit(0).cast("bigint"))
    return parsed.select(
        F.lit(TICKER_PLATFORM).alias("platform"), "market_id", "period_min", from_seconds(end).alias("ts"),
        *[_ohlc(v, f).alias(f) for f in ("open", "high", "low", "close")],
        amount("volume").alias("volume"), amount("open_interest").alias("open_interest"), "raw")


def _on(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


def normalize_exchange_status(polls: DataFrame, value: str = "value", time: str = "ts") -> DataFrame:
    """Polls as (platform, ts, active); a failed poll (NULL document) has NULL active."""
    d = F.col("d")
    parsed = polls.select(F.col(time).alias("ts"), F.col(value).isNotNull().alias("given"),
                          F.from_json(value, _STATUS).alias("d"))
    first = F.filter(d["exchange_index_statuses"], lambda x: x["exchange_index"] == 0)
    all_on = F.coalesce(F.forall(first, lambda x: _on(x["trading_active"]) & _on(x["exchange_active"])), F.lit(True))
    active = _on(d["exchange_active"]) & _on(d["trading_active"]) & all_on
    return parsed.select(F.lit(TICKER_PLATFORM).alias("platform"), "ts", F.when(F.col("given"), active).alias("active"))


def normalize_maintenance(schedules: DataFrame, value: str = "value") -> DataFrame:
    """Scheduled maintenance windows as outage rows; an open end is NULL."""
    w = F.col("w")
    windows = (schedules.select(F.from_json(value, _SCHEDULE).alias("d"))
               .select(F.explode("d.schedule.maintenance_windows").alias("note"))
               .select("note", F.from_json("note", _WINDOW).alias("w")))

    def at(side):
        return parse_ts(F.coalesce(_given(w[f"{side}_datetime"]), _given(w[f"{side}_time"])))

    rows = windows.select(F.lit(TICKER_PLATFORM).alias("platform"), F.lit("maintenance").alias("kind"),
                          at("start").alias("start_ts"), at("end").alias("end_ts"), "note")
    return rows.filter(F.col("start_ts") != 0)
