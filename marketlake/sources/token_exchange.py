"""Landing records of the token exchange: events, books and trades as raw JSON.

Each document is parsed once into the few members that are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import TOKEN_PLATFORM, TOKEN_SERIES
from ..functions.hashes import book_hash, trade_hash
from ..functions.numbers import to_double
from ..functions.times import from_millis, from_seconds, parse_ts

_STRINGS = "array<string>"
_LEVELS = "array<struct<price:string,size:string>>"
_EVENT = "struct<slug:string,startTime:string,eventDate:string,markets:array<string>>"
_MARKET = ("struct<clobTokenIds:string,outcomes:string,gameStartTime:string,conditionId:string,question:string,"
           "startDate:string,endDate:string,closed:string,umaResolutionStatus:string>")
_BOOK = f"struct<asset_id:string,timestamp:string,bids:{_LEVELS},asks:{_LEVELS}>"
_TRADE = ("struct<timestamp:string,transactionHash:string,proxyWallet:string,asset:string,price:string,"
          "size:string,side:string>")


def _strings(text: Column) -> Column:
    """An array member, whether it was JSON or text holding JSON; unreadable is empty."""
    return F.coalesce(F.from_json(text, _STRINGS), F.array().cast(_STRINGS))


def _truthy(text: Column) -> Column:
    return F.coalesce(~F.lower(text).isin("false", "0", "0.0", "", "[]", "{}"), F.lit(False))


def normalize_token_markets(events: DataFrame, value: str = "value") -> DataFrame:
    """One row per outcome token of every market of every event."""
    d, members = F.col("d"), F.col("members")
    markets = (events.select(F.from_json(value, _EVENT).alias("ev"))
               .select("ev.slug", "ev.startTime", "ev.eventDate", F.explode("ev.markets").alias("m"))
               .select("slug", "startTime", "eventDate", "m", F.from_json("m", _MARKET).alias("d"),
                       F.from_json("m", "map<string,string>").alias("members")))
    has_book = (~F.map_contains_key(members, "enableOrderBook")
                | _truthy(F.try_element_at(members, F.lit("enableOrderBook"))))
    # Only a market that repeats its events is rewritten (nested values then as text).
    raw = F.when(F.map_contains_key(members, "events"),
                 F.to_json(F.map_filter(members, lambda k, v: k != "events"))).otherwise(F.col("m"))

    def nonzero(text):
        ts = parse_ts(text)
        return F.when(ts != 0, ts)

    start = F.coalesce(nonzero(d["gameStartTime"]), nonzero(F.col("startTime")), parse_ts(F.col("eventDate")))
    rows = (markets.filter(has_book)
            .withColumn("outcomes", _strings(d["outcomes"])).withColumn("raw", raw)
            .withColumn("game_start_ts", start)
            .withColumn("open_ts", parse_ts(d["startDate"])).withColumn("close_ts", parse_ts(d["endDate"]))
            .select("*", F.posexplode(_strings(d["clobTokenIds"])).alias("i", "token")))
    return rows.select(
        F.lit(TOKEN_PLATFORM).alias("platform"), F.col("token").alias("market_id"),
        F.col("slug").alias("event_id"), F.lit(TOKEN_SERIES).alias("series"),
        d["conditionId"].alias("condition_id"), d["question"].alias("title"),
        F.coalesce(F.get("outcomes", F.col("i")), F.col("i").cast("string")).alias("outcome"),
        "game_start_ts", "open_ts", "close_ts",
        F.when(_truthy(d["closed"]), "closed").otherwise("open").alias("status"),
        d["umaResolutionStatus"].alias("result"), "raw")


def sorted_levels(levels: Column, best_first_high: bool) -> Column:
    """Levels by price, best first; equal prices keep their order."""
    keyed = F.transform(levels, lambda x, i: F.struct(
        (-x["price"] if best_first_high else x["price"]).alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda r: r["x"])


def with_sides(rows: DataFrame, bids: Column, asks: Column) -> DataFrame:
    """Add both sides, best level first, and the book's hash."""
    none = F.array().cast("array<struct<price:double,size:double>>")
    return (rows.withColumn("bids", sorted_levels(F.coalesce(bids, none), True))
            .withColumn("asks", sorted_levels(F.coalesce(asks, none), False))
            .withColumn("hash", book_hash(F.col("bids"), F.col("asks"))))


def normalize_books_twosided(books: DataFrame, value: str = "value", capture: str = "capture_ts") -> DataFrame:
    """One book per document with both sides given as price and size text."""
    d = F.col("d")

    def side(levels):
        return F.transform(levels, lambda x: F.struct(to_double(x["price"]).alias("price"),
                                                      to_double(x["size"]).alias("size")))

    stamp = d["timestamp"].try_cast("bigint")
    rows = (books.select(F.col(capture).alias("ts"), F.from_json(value, _BOOK).alias("d"))
            .withColumn("platform", F.lit(TOKEN_PLATFORM)).withColumn("market_id", d["asset_id"])
            .withColumn("source_ts", F.when(stamp != 0, from_millis(stamp))))
    return (with_sides(rows, side(d["bids"]), side(d["asks"]))
            .select("platform", "market_id", "ts", "source_ts", "bids", "asks", "hash"))


def normalize_token_trades(trades: DataFrame, value: str = "value") -> DataFrame:
    """Trades identified by a hash of their fields."""
    d = F.col("d")
    parsed = (trades.select(F.col(value).alias("raw"), F.from_json(value, _TRADE).alias("d"))
              .withColumn("t", F.coalesce(d["timestamp"].try_cast("bigint"), F.lit(0).cast("bigint"))))
    trade_id = trade_hash(F.coalesce(d["transactionHash"], F.lit("")), d["proxyWallet"], d["asset"], F.col("t"),
                          d["price"], d["size"], d["side"])
    zero = F.lit(0.0)
    return parsed.select(
        F.lit(TOKEN_PLATFORM).alias("platform"), trade_id.alias("trade_id"),
        F.coalesce(d["asset"], F.lit("None")).alias("market_id"), from_seconds(F.col("t")).alias("ts"),
        F.coalesce(to_double(d["price"]), zero).alias("price"), F.coalesce(to_double(d["size"]), zero).alias("size"),
        F.lower(F.coalesce(d["side"], F.lit(""))).alias("side"), "raw")
