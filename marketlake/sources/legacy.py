"""Import of the six tables of an earlier store, through the usual write rules.

The dump has unix seconds (books: milliseconds) instead of timestamps and JSON
text instead of arrays. Importing twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashes import book_hash
from ..functions.numbers import to_double
from ..functions.times import from_millis, from_seconds
from ..operators.merge import coalesce_merge, current_outages, insert_if_absent, last_write_wins, new_rows
from ..schemas import KEYS, MARKETS

TABLE_NAMES = ("markets", "book_snapshots", "trades", "price_points", "candles", "outages")
#: Tables whose stored rows never change.
GROWING = ("book_snapshots", "trades", "price_points")
CATALOG = ["event_id", "series", "condition_id", "title", "outcome", "game_start_ts", "open_ts",
           "close_ts", "status", "result", "raw"]


#: The column whose hash deals a database table's rows out to tasks.
DEALT_BY = {"markets": "market_id", "book_snapshots": "market_id", "trades": "trade_id", "price_points": "market_id",
            "candles": "market_id", "outages": "start_ts"}
#: Part of a row in the dialect of the earlier store (PostgreSQL).
HASH_PART = "mod(mod(hashtext({key}::text), {n}) + {n}, {n})"


def read_dump(spark: SparkSession, root: str, fmt: str = "parquet", *, parts: int = 1, part: str = HASH_PART,
              **options) -> dict[str, DataFrame]:
    """Tables of a dump in files, or of a database with ``fmt='jdbc'`` and its options.

    A database is read by ``parts`` tasks a table, each with the rows whose key hash falls to it.
    ``part`` is SQL for a row's part, from 0, in the database's dialect; NULL keys go to part 0.
    """
    if fmt == "jdbc":
        return {t: _read_parts(spark, t, parts, part, options) for t in TABLE_NAMES}
    return {t: spark.read.format(fmt).options(**options).load(f"{root}/{t}") for t in TABLE_NAMES}


def _read_parts(spark: SparkSession, table: str, parts: int, part: str, options: dict) -> DataFrame:
    key = DEALT_BY[table]
    of = part.format(key=key, n=parts)
    rows = [f"{of} = {i}" if i else f"({of} = 0 OR {key} IS NULL)" for i in range(parts)]
    given = dict(options)
    return spark.read.jdbc(given.pop("url"), table, predicates=rows, properties=given)


def _raw(col: str = "raw") -> Column:
    return F.coalesce(F.when(F.col(col) != "", F.col(col)), F.lit("{}"))


def _levels(col: str) -> Column:
    pairs = F.from_json(F.col(col), "array<array<string>>")
    return F.transform(pairs, lambda x: F.struct(to_double(F.get(x, F.lit(0))).alias("price"),
                                                 to_double(F.get(x, F.lit(1))).alias("size")))


def import_legacy_tables(dump: dict[str, DataFrame], stored: dict[str, DataFrame] | None = None, *,
                         whole: bool = True) -> dict[str, DataFrame]:
    """The six tables after importing ``dump`` into ``stored`` (default: nothing stored).

    Series tables come back whole (stored plus new rows), ready to write to a new path. With
    ``whole=False`` the tables of ``GROWING`` are their new rows alone, to be appended.

    A dump's files may be few and dense, so rows are dealt out by key before they are parsed
    and sorted, and those whose key is stored already are dropped before.
    """
    stored = stored or {}

    def appended(name: str, rows: DataFrame, **values: Column) -> DataFrame:
        """``rows`` have their keys; ``values`` are worked out for rows that are not stored only."""
        old = stored.get(name)
        rows = rows.repartition(*KEYS[name]) if old is None else new_rows(rows, old, KEYS[name])
        for column, value in values.items():
            rows = rows.withColumn(column, value)
        rows = rows.select(*(old.columns if old is not None else rows.columns))
        new = insert_if_absent(rows, KEYS[name], [c for c in rows.columns if c not in KEYS[name]
                                                  and c not in ("bids", "asks")] or KEYS[name])
        return old.unionByName(new) if whole and old is not None else new

    m = dump["markets"]
    seen = F.coalesce("last_seen_ts", F.lit(0)).cast("bigint")
    zero = lambda c, t: F.coalesce(F.col(c), F.lit(0)).cast(t).alias(c)
    sightings = m.select("platform", "market_id", *[F.col(c).cast(MARKETS[c].dataType).alias(c) for c in CATALOG],
                         zero("backfilled", "smallint"), zero("last_trade_ts", "bigint"),
                         zero("outage_affected", "smallint"), seen.alias("seen"), F.lit(1).alias("seq"))
    if "markets" in stored:
        old = stored["markets"].select(
            "platform", "market_id", *CATALOG, "backfilled", "last_trade_ts", "outage_affected",
            F.col("first_seen_ts").alias("seen"), F.lit(0).alias("seq"))
        sightings = old.unionByName(sightings)
    markets = coalesce_merge(sightings.repartition("platform", "market_id"), ["platform", "market_id"], ["seq"],
                             [*CATALOG, "backfilled", "last_trade_ts", "outage_affected"],
                             seen="seen", raw="raw").select(*MARKETS.names)

    books = dump["book_snapshots"].select(
        "platform", "market_id", from_millis(F.col("ts_ms")).alias("ts"),
        from_millis(F.when(F.col("source_ts_ms") != 0, F.col("source_ts_ms"))).alias("source_ts"), "bids", "asks")
    trades = dump["trades"].select("platform", "trade_id", "market_id", from_seconds(F.col("ts")).alias("ts"),
                                   "price", "size", "side", _raw().alias("raw"))
    points = dump["price_points"].select("platform", "market_id", F.col("fidelity").cast("int").alias("fidelity"),
                                         from_seconds(F.col("ts")).alias("ts"), "price")
    candles = dump["candles"].select(
        "platform", "market_id", F.col("period_min").cast("int").alias("period_min"),
        from_seconds(F.col("ts")).alias("ts"), "open", "high", "low", "close", "volume", "open_interest",
        _raw().alias("raw"), F.lit(1).alias("__seq"))
    if "candles" in stored:
        candles = stored["candles"].withColumn("__seq", F.lit(0)).unionByName(candles)
    candles = last_write_wins(candles.repartition(*KEYS["candles"]), KEYS["candles"], ["__seq", "close", "volume"]).drop("__seq")

    o = dump["outages"].select("platform", "kind", F.col("start_ts").cast("bigint").alias("start_ts"),
                               F.col("end_ts").cast("bigint").alias("end_ts"), "note")
    openings = o.withColumn("end_ts", F.lit(None).cast("bigint"))
    closings = o.filter(F.col("end_ts") != 0)
    if "outages" in stored:
        openings = stored["outages"].unionByName(openings)
    outages = current_outages(openings, closings, ["platform", "kind"])
    # Hashes are recomputed: number text differs between systems.
    books = appended("book_snapshots", books, bids=_levels("bids"), asks=_levels("asks"), hash=book_hash(F.col("bids"), F.col("asks")))
    return {"markets": markets, "book_snapshots": books,
            "trades": appended("trades", trades), "price_points": appended("price_points", points),
            "candles": candles, "outages": outages}
