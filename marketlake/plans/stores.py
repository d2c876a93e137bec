"""Stored tables written and read again: exports, imports, match files, and results not bound elsewhere."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashes import book_hash
from ..functions.numbers import sql_round
from ..operators.calibration import brier, rejected
from ..operators.catalog import coverage_of_counts, event_outages
from ..operators.scoring import prefix_state
from ..session import scratch_path, shuffles_dropped
from ..sinks.export import export_events
from ..sinks.rollup import Rollup
from ..sinks.upsert import latest, upsert
from ..sources.legacy import GROWING, import_legacy_tables, read_dump
from ..sources.matches import load_match_csv, reload_games
from .draft import order_drafts
from .registry import query, rounded
from .trading import EARLY, NOW, _export_tables, match_loads

_EVENTS_SQL = """
WITH o AS (SELECT *, CAST(epoch(o_orderdate) AS BIGINT) AS g,
                  regexp_replace('x_c ' || o_custkey % 40, '[^A-Za-z0-9_.-]', '_', 'g') || '-' || md5('x' || chr(10) || 'c ' || o_custkey % 40)[1:8] AS dir
           FROM orders),
l AS (SELECT *, CAST(epoch(l_shipdate) AS BIGINT) AS s FROM lineitem JOIN o ON l_orderkey = o_orderkey)
"""


@query("export_files", _EVENTS_SQL + f""",
e AS (SELECT dir, min(g) AS g FROM o GROUP BY dir)
SELECT 'markets' AS tbl, dir, count(*) AS n, CAST(sum(g) AS BIGINT) AS total FROM o GROUP BY dir
UNION ALL SELECT 'book_snapshots', dir, count(*), CAST(sum(s * 1000) AS BIGINT) FROM l GROUP BY dir
UNION ALL SELECT 'trades', dir, count(*), CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) FROM l GROUP BY dir
UNION ALL SELECT 'candles', dir, count(*), CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) FROM l GROUP BY dir
UNION ALL SELECT 'price_points', dir, count(*), CAST(sum(s) AS BIGINT) FROM l GROUP BY dir
UNION ALL SELECT 'outages', dir, count(*), CAST(sum({EARLY} + s_suppkey * 1000000) AS BIGINT) FROM e JOIN supplier
  ON {EARLY} + s_suppkey * 1000000 - 28800 <= g AND g <= {EARLY} + s_suppkey * 1000000 + 200000 + 2700 GROUP BY dir""")
def export_files(t):
    """All six tables of forty events written as CSV; rows and a checksum of each event's files read back."""
    summed = {"markets": "game_start_ts", "book_snapshots": "ts_ms", "trades": "size", "candles": "volume", "price_points": "ts",
              "outages": "start_ts"}
    tables = _export_tables(t, F.concat(F.lit("c "), F.col("o_custkey") % 40))
    events = tables["markets"].select("platform", "event_id").distinct()
    paths = export_events(tables, events, scratch_path(t.spark, "export"), NOW)
    out = None
    for path in paths:
        name = path.rsplit("/", 1)[1]
        rows = t.spark.read.option("header", True).csv(path)
        files = (rows.groupBy("dir").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col(summed[name]).cast("double")).cast("bigint")).alias("total"))
                 .select(F.lit(name).alias("tbl"), "dir", "n", "total"))
        out = files if out is None else out.unionByName(files)
    return out


@query("event_outages", f"""
WITH e AS (SELECT o_custkey, min(CAST(epoch(o_orderdate) AS BIGINT)) AS g FROM orders GROUP BY o_custkey)
SELECT 'c ' || o_custkey AS event_id, g AS game_start_ts, {EARLY} + s_suppkey * 1000000 AS start_ts FROM e JOIN supplier
ON {EARLY} + s_suppkey * 1000000 - 28800 <= g AND g <= {EARLY} + s_suppkey * 1000000 + 200000 + 2700""")
def event_outages_query(t):
    """Outages that touch the window of each customer's first order."""
    tables = _export_tables(t)
    return event_outages(tables["markets"], tables["outages"], NOW).select("event_id", "game_start_ts", "start_ts")


@query("book_hash", """
WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  '{"b":[{"price":' || l_discount || ',"size":' || l_quantity || '},{"price":' || l_tax || ',"size":' || CAST(l_linenumber AS DOUBLE) || '}],"a":'
  || CASE WHEN l_returnflag = 'N' THEN '[]' ELSE '[{"price":' || l_quantity || ',"size":' || l_discount || '}]' END || '}' AS j FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, sha1(j) AS hash FROM b""")
def book_hash_query(t):
    """Hashes of books with two bids and at most one ask."""
    def level(price, size):
        return F.struct(F.col(price).alias("price"), F.col(size).cast("double").alias("size"))

    ask = F.array(level("l_quantity", "l_discount"))
    asks = F.when(F.col("l_returnflag") == "N", F.slice(ask, 1, 0)).otherwise(ask)
    bids = F.array(level("l_discount", "l_quantity"), level("l_tax", "l_linenumber"))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", book_hash(bids, asks).alias("hash"))


@query("rejected_prices", f"""
WITH p AS (SELECT l_returnflag AS platform, l_quantity / 40 AS p, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS y FROM lineitem)
SELECT platform, count(*) FILTER (WHERE p <= 1) AS n, {rounded('avg((p - y) * (p - y)) FILTER (WHERE p <= 1)', 5)} AS brier,
       count(*) FILTER (WHERE p > 1) AS n_rejected FROM p GROUP BY platform""")
def rejected_prices(t):
    """Brier scores of usable prices beside how many prices outside [0, 1] were left out."""
    pairs = t("lineitem").select(F.col("l_returnflag").alias("platform"), (F.col("l_quantity") / 40).alias("p"),
                                 F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("y"))
    return (brier(pairs, ["A", "N", "R"]).join(rejected(pairs, ["platform"]).withColumnRenamed("n", "n_rejected"), "platform", "left")
            .select("platform", "n", sql_round(F.col("brier"), 5).alias("brier"), F.coalesce("n_rejected", F.lit(0)).alias("n_rejected")))


@query("prefix_state", """
WITH a AS (SELECT DISTINCT l_orderkey AS g, replace(p_brand, '#', '') AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
d AS (SELECT g, c, row_number() OVER (PARTITION BY g ORDER BY c) - 1 AS i FROM a),
x AS (SELECT g, i + 1 AS step, c, i % 2 = 0 AS blue, i % 3 = 2 AS ban FROM d)
SELECT g AS draft_id, CAST(step AS INTEGER) AS step,
       coalesce(string_agg(c, ',' ORDER BY step) FILTER (WHERE blue AND NOT ban) OVER w, '') AS own_picks,
       coalesce(string_agg(c, ',' ORDER BY step) FILTER (WHERE NOT blue AND NOT ban) OVER w, '') AS enemy_picks,
       coalesce(string_agg(c, ',' ORDER BY step) FILTER (WHERE blue AND ban) OVER w, '') AS own_bans,
       coalesce(string_agg(c, ',' ORDER BY step) FILTER (WHERE NOT blue AND ban) OVER w, '') AS enemy_bans
FROM x WINDOW w AS (PARTITION BY g ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def prefix_state_query(t):
    """Picks and bans of both sides after every step of every order's draft."""
    sided = order_drafts(t).withColumn("side", F.upper(F.substring("side", 1, 1)))
    sets = ("own_picks", "enemy_picks", "own_bans", "enemy_bans")
    return prefix_state(sided).select("draft_id", F.col("step").cast("int").alias("step"), *[F.array_join(c, ",").alias(c) for c in sets])


@query("match_files", """
WITH j AS (SELECT *, CAST(l_orderkey AS VARCHAR) AS game_id, 'T' || l_linestatus AS team FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
a AS (SELECT *, CASE WHEN l_linestatus = o_orderstatus THEN team END AS won FROM j WHERE l_orderkey % 3 <> 0),
b AS (SELECT *, CASE WHEN l_linestatus <> 'F' THEN team END AS won FROM j WHERE l_orderkey % 3 <> 1),
k AS (SELECT *, o_orderdate AS d, 0 AS late FROM a UNION ALL SELECT *, o_orderdate + INTERVAL 1 DAY, 1 FROM b)
SELECT game_id, min(o_orderpriority) AS league, CAST(epoch(max(d)) AS BIGINT) AS date_utc, CAST(1 AS INTEGER) AS game_num,
       min(strftime(o_orderdate, '%Y')) AS patch, max(CASE WHEN l_linestatus = 'F' THEN team END) AS blue_team,
       max(CASE WHEN l_linestatus <> 'F' THEN team END) AS red_team,
       CASE WHEN max(late) = 1 THEN max(won) FILTER (WHERE late = 1) ELSE max(won) END AS winner
FROM k GROUP BY game_id""")
def match_files(t):
    """Match rows in two CSV files, the second with other winners and a day later; both loaded one after the other."""
    path = scratch_path(t.spark, "matches")
    # A game's rows lie in one file, as they are published.
    with shuffles_dropped(t.spark):
        match_loads(t).write.partitionBy("load").option("header", True).option("compression", "gzip").csv(path)
    first, second = (load_match_csv(t.spark, f"{path}/load={name}")["oe_games"] for name in "ab")
    return reload_games(first, second)


@query("import_twice", """
WITH l AS (SELECT CAST(l_orderkey AS VARCHAR) AS m, l_linenumber AS i, CAST(epoch(l_shipdate) AS BIGINT) AS s, l_discount, l_tax, l_quantity FROM lineitem),
u AS (SELECT DISTINCT m, i, s FROM l)
SELECT 'trades' AS tbl, count(*) AS n, CAST(sum(s) AS BIGINT) AS total FROM u
UNION ALL SELECT 'price_points', count(*), CAST(sum(s) AS BIGINT) FROM (SELECT DISTINCT m, i % 3, s FROM l)
UNION ALL SELECT 'candles', count(*), CAST(sum(s) AS BIGINT) FROM (SELECT DISTINCT m, i % 2, s FROM l)
UNION ALL SELECT 'markets', count(*), CAST(sum(CAST(epoch(o_orderdate) AS BIGINT)) AS BIGINT) FROM orders
UNION ALL SELECT 'outages', count(*), CAST(sum(s_suppkey * 100) AS BIGINT) FROM supplier""")
def import_twice(t):
    """A dump of an earlier store in files, imported twice: rows and a checksum of each table after the second time."""
    path = scratch_path(t.spark, "dump")
    x, nothing = F.lit("x").alias("platform"), F.lit(None).cast("string")
    lines = t("lineitem").select(x, F.col("l_orderkey").cast("string").alias("market_id"), F.col("l_linenumber").alias("i"),
                                 F.unix_timestamp("l_shipdate").alias("ts"), "l_discount", "l_tax", "l_quantity")
    start = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    dump = {
        "markets": t("orders").select(
            x, F.col("o_orderkey").cast("string").alias("market_id"), F.col("o_custkey").cast("string").alias("event_id"),
            *[nothing.alias(c) for c in ("series", "condition_id", "title", "outcome", "result", "raw")], F.col("o_orderstatus").alias("status"),
            start.alias("game_start_ts"), *[F.lit(None).cast("long").alias(c) for c in ("open_ts", "close_ts", "last_trade_ts")],
            *[F.lit(0).alias(c) for c in ("backfilled", "outage_affected")], start.alias("first_seen_ts"), start.alias("last_seen_ts")),
        "book_snapshots": lines.select("platform", "market_id", (F.col("ts") * 1000).alias("ts_ms"), F.lit(0).cast("long").alias("source_ts_ms"),
                                       F.to_json(F.array(F.array("l_discount", "l_quantity"))).alias("bids"), F.lit("[]").alias("asks")),
        "trades": lines.select("platform", F.concat_ws("-", "market_id", "i", "ts").alias("trade_id"), "market_id", "ts",
                               F.col("l_discount").alias("price"), F.col("l_quantity").alias("size"), nothing.alias("side"), nothing.alias("raw")),
        "price_points": lines.select("platform", "market_id", (F.col("i") % 3).alias("fidelity"), "ts", F.lit(0.5).alias("price")),
        "candles": lines.select("platform", "market_id", (F.col("i") % 2).alias("period_min"), "ts", *[F.col("l_tax").alias(c) for c in ("open", "high", "low", "close")],
                                F.col("l_quantity").alias("volume"), F.lit(0.0).alias("open_interest"), nothing.alias("raw")),
        "outages": t("supplier").select(x, F.concat(F.lit("k"), "s_suppkey").alias("kind"), (F.col("s_suppkey") * 100).alias("start_ts"),
                                        (F.col("s_suppkey") * 100 + 5).alias("end_ts"), F.lit("n").alias("note")),
    }
    for name, rows in dump.items():
        rows.write.parquet(f"{path}/dump/{name}")
    stored = None
    for turn in ("first", "second"):
        made = import_legacy_tables(read_dump(t.spark, f"{path}/dump"), stored, whole=False)
        # Stored rows of tables that only grow stay where they are.
        lies = {name: f"{path}/{'series' if name in GROWING else turn}/{name}" for name in made}
        for name, rows in made.items():
            rows.write.mode("append").parquet(lies[name])
        stored = {name: t.spark.read.parquet(lies[name]) for name in made}
    times = {"trades": F.unix_timestamp("ts"), "price_points": F.unix_timestamp("ts"), "candles": F.unix_timestamp("ts"),
             "markets": F.col("game_start_ts"), "outages": F.col("start_ts")}
    out = None
    for name, at in times.items():
        row = stored[name].agg(F.count(F.lit(1)).alias("n"), F.sum(at).alias("total")).select(F.lit(name).alias("tbl"), "n", "total")
        out = row if out is None else out.unionByName(row)
    return out


@query("upsert_weeks", """
WITH l AS (SELECT l_returnflag AS platform, CAST(l_orderkey AS VARCHAR) AS market_id, (CAST(epoch(l_shipdate) AS BIGINT) + l_orderkey * 3600) % 4838400 AS s,
                  l_discount, l_tax, l_quantity FROM lineitem),
a AS (SELECT platform, market_id, s, max(l_discount) AS price FROM l GROUP BY ALL),
b AS (SELECT platform, market_id, s, max(l_tax) AS price FROM l WHERE l_quantity > 40 AND s < 1209600 GROUP BY ALL)
SELECT a.platform, a.market_id, a.s, coalesce(b.price, a.price) AS price FROM a LEFT JOIN b USING (platform, market_id, s)""")
def upsert_weeks(t):
    """A stored series whose first weeks are corrected, twice by the same batch, in place."""
    path = scratch_path(t.spark, "weekly")
    lines = t("lineitem").select(
        F.col("l_returnflag").alias("platform"), F.col("l_orderkey").cast("string").alias("market_id"),
        ((F.unix_timestamp("l_shipdate") + F.col("l_orderkey") * 3600) % 4_838_400).alias("s"), "l_discount", "l_tax", "l_quantity")
    keys = ["platform", "market_id", "s"]

    def dated(rows, price):
        return rows.groupBy(*keys).agg(F.max(price).alias("price")).withColumn("ts", F.timestamp_seconds("s"))

    rule = latest(keys, ["price"])
    upsert(dated(lines, "l_discount"), path, rule, sort=["market_id", "ts"])
    for _ in range(2):
        upsert(dated(lines.filter("l_quantity > 40 and s < 1209600"), "l_tax"), path, rule, sort=["market_id", "ts"])
    return t.spark.read.parquet(path).select(*keys, "price")


@query("coverage_rollup", """
SELECT 'c ' || o_custkey AS event_id, count(l_orderkey) AS trades, count(l_orderkey) FILTER (WHERE l_returnflag = 'R') AS returned
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey""")
def coverage_rollup(t):
    """Stored rows per customer from counts kept while six batches were written, one of them twice."""
    tables, path = _export_tables(t), scratch_path(t.spark, "rollup")
    lines = tables["trades"].withColumn("part", F.pmod(F.xxhash64("market_id", "trade_id"), F.lit(6)))
    rollups = {name: Rollup(t.spark, f"{path}/{name}", merge_after=3) for name in ("trades", "returned")}
    for i in (0, 1, 2, 2, 3, 4, 5):
        batch = lines.filter(F.col("part") == i)
        rollups["trades"].add(batch, f"batch-{i}")
        rollups["returned"].add(batch.filter("side = 'R'"), f"batch-{i}")
    return coverage_of_counts(tables["markets"], {name: r.markets() for name, r in rollups.items()}).drop("platform")
