"""Orders as markets, order lines as trades, books and candles, customers as events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import TICKER_PLATFORM, TOKEN_PLATFORM
from ..functions.texts import norm_team
from ..functions.times import micros, parse_ts, ticker_start
from ..operators.calibration import calibration
from ..operators.catalog import (coverage, event_markets, event_members, ilike_any, inner_catalog, platform_status,
                                 search_games, search_with_coverage, watch_tiers)
from ..operators.history import backfill_worklist, history_chunks, month_windows, with_task, worklist_tasks
from ..operators.merge import partial_upsert, set_fields
from ..operators.series import finest_series, mid_series
from ..sinks.append import append_series
from ..sinks.export import export_rows
from ..session import scratch_path
from ..sources.matches import match_bans, match_games, match_picks
from ..sources.ticker_exchange import (normalize_books_yes_no, normalize_candles, normalize_exchange_status,
                                       normalize_maintenance, normalize_ticker_markets, normalize_ticker_trades)
from ..sources.token_exchange import (normalize_books_twosided, normalize_token_markets, normalize_token_trades)
from .registry import query

#: 1998-10-03 02:00, inside the order dates.
NOW = 907380000
#: 1995-01-01, before them.
EARLY = 788918400
DAY = 86400


def _seconds(col):
    return F.floor(micros(F.col(col)) / 1_000_000).cast("bigint")


def order_markets(t):
    """Orders as a market catalog: urgent and high ones are tokens, the others tickers."""
    token = F.col("o_orderpriority") < "3"
    start = F.when(F.col("o_orderpriority") != "3-MEDIUM", _seconds("o_orderdate"))
    status = (F.when(token & (F.col("o_orderstatus") == "F"), "closed")
              .when(F.col("o_orderstatus") == "F", "settled")
              .when(~token & (F.col("o_orderstatus") == "P"), "active").otherwise("open"))
    volume = (F.when(F.col("o_totalprice") < 50000, F.to_json(F.struct(F.lit("0.00").alias("volume_fp"))))
              .when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.to_json(F.struct(
                  F.lit("?").alias("volumeNum"), F.col("o_totalprice").alias("volume"))))
              .otherwise(F.lit("{}")))
    return t("orders").select(
        F.when(token, TOKEN_PLATFORM).otherwise(TICKER_PLATFORM).alias("platform"),
        F.col("o_orderkey").cast("string").alias("market_id"),
        F.concat(F.lit("C"), F.col("o_custkey")).alias("event_id"), F.col("o_orderpriority").alias("series"),
        F.when(token, F.col("o_custkey").cast("string")).alias("condition_id"),
        F.concat("o_orderpriority", F.lit(" order")).alias("title"), F.col("o_orderstatus").alias("outcome"),
        start.alias("game_start_ts"), F.lit(None).cast("bigint").alias("open_ts"),
        F.when(F.col("o_orderpriority") != "5-LOW", start + F.col("o_custkey") % 40 * DAY).alias("close_ts"),
        status.alias("status"), F.lit(None).cast("string").alias("result"),
        F.lit(None).cast("bigint").alias("last_trade_ts"),
        F.when(F.col("o_totalprice") > 400000, 1).otherwise(0).cast("smallint").alias("backfilled"),
        F.when(F.col("o_totalprice") > 300000, 1).otherwise(0).cast("smallint").alias("outage_affected"),
        volume.alias("raw"))


_MARKETS_SQL = f"""
WITH markets AS (
  SELECT *, CASE WHEN o_orderpriority < '3' THEN '{TOKEN_PLATFORM}' ELSE '{TICKER_PLATFORM}' END AS platform,
    CAST(o_orderkey AS VARCHAR) AS market_id, 'C' || o_custkey AS event_id,
    CASE WHEN o_orderpriority < '3' THEN CAST(o_custkey AS VARCHAR) END AS condition_id,
    o_orderpriority || ' order' AS title, o_orderstatus AS outcome,
    CASE WHEN o_orderpriority <> '3-MEDIUM' THEN CAST(epoch(o_orderdate) AS BIGINT) END AS game_start_ts,
    CASE WHEN o_orderpriority NOT IN ('3-MEDIUM', '5-LOW')
         THEN CAST(epoch(o_orderdate) AS BIGINT) + o_custkey % 40 * 86400 END AS close_ts,
    CASE WHEN o_orderpriority < '3' THEN CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open' END
         WHEN o_orderstatus = 'F' THEN 'settled' WHEN o_orderstatus = 'P' THEN 'active' ELSE 'open' END AS status,
    CASE WHEN o_totalprice > 400000 THEN 1 ELSE 0 END AS backfilled,
    CASE WHEN o_totalprice > 300000 THEN 1 ELSE 0 END AS outage_affected,
    CASE WHEN o_totalprice < 50000 THEN 0.0 WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_totalprice END AS volume
  FROM orders)
"""


def order_lines(t):
    """Order lines as rows of a series table of the order's market."""
    return t("lineitem").withColumn("market_id", F.col("l_orderkey").cast("string"))


# ---------------------------------------------------------------- search and status

def part_markets(t):
    return t("part").select(
        F.col("p_brand").alias("platform"), F.col("p_partkey").cast("string").alias("market_id"),
        F.col("p_type").alias("event_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("outcome"),
        (F.col("p_size") * DAY).cast("bigint").alias("game_start_ts"), (F.col("p_size") % 2).alias("outage_affected"))


_SEARCH_SQL = """
found AS (
  SELECT p_brand AS platform, p_type AS event_id, count(*) AS n_markets,
         min(CAST(p_size AS BIGINT) * 86400) AS game_start_ts, min(p_name) AS sample_title,
         max(p_size % 2) AS outage_affected
  FROM part WHERE (p_type ILIKE '%red%' OR p_name ILIKE '%red%' OR p_brand ILIKE '%red%')
              AND (p_type ILIKE '%CO%' OR p_name ILIKE '%CO%' OR p_brand ILIKE '%CO%')
  GROUP BY ALL ORDER BY game_start_ts DESC NULLS LAST, platform, event_id LIMIT 100)
"""


@query("search_games", "WITH " + _SEARCH_SQL + "SELECT * FROM found")
def search_games_query(t):
    """Parts as markets, kinds as events: two text terms."""
    return search_games(part_markets(t), ["red", "CO"])


@query("search_day", _MARKETS_SQL + """
SELECT platform, event_id, count(*) AS n_markets, min(game_start_ts) AS game_start_ts, min(title) AS sample_title,
       max(outage_affected) AS outage_affected
FROM markets WHERE game_start_ts BETWEEN 907372800 AND 907459200 GROUP BY platform, event_id
ORDER BY game_start_ts DESC NULLS LAST, platform, event_id LIMIT 100""")
def search_day(t):
    """Orders of one day (both midnights included)."""
    m = order_markets(t)
    return search_games(m, ["1998-10-03"]).withColumn("outage_affected", F.col("outage_affected").cast("int"))


@query("search_coverage", "WITH " + _SEARCH_SQL + """,
s AS (SELECT p_brand AS platform, p_type AS event_id, count(*) AS trades,
             count(*) FILTER (WHERE l_returnflag = 'R') AS returned
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT f.*, coalesce(s.trades, 0) AS trades, coalesce(s.returned, 0) AS returned FROM found f
LEFT JOIN s ON s.platform = f.platform AND s.event_id = f.event_id""")
def search_coverage(t):
    """Search results with the stored rows of all markets of each found event."""
    m = part_markets(t)
    lines = (t("lineitem").withColumn("market_id", F.col("l_partkey").cast("string"))
             .join(m.select("platform", "market_id"), "market_id"))
    return search_with_coverage(m, {"trades": lines, "returned": lines.filter("l_returnflag = 'R'")}, ["red", "CO"])


@query("ilike_any", """
SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority ILIKE '%urgent%' OR o_orderpriority ILIKE '%low%'""")
def ilike_any_query(t):
    return ilike_any(t("orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "urgent, Low")


@query("platform_status", _MARKETS_SQL + f""",
p AS (SELECT unnest(['{TOKEN_PLATFORM}', '{TICKER_PLATFORM}']) AS platform),
l AS (SELECT m.platform, count(*) AS n, max(epoch_ms(l_shipdate)) AS latest_ms, count(*) FILTER (WHERE l_returnflag = 'R') AS r
      FROM lineitem JOIN markets m ON l_orderkey = o_orderkey GROUP BY m.platform),
m AS (SELECT platform, count(*) AS n_markets, count(*) FILTER (WHERE status IN ('open', 'active')) AS n_open,
             CAST(sum(backfilled) AS BIGINT) AS n_backfilled FROM markets GROUP BY platform)
SELECT p.platform, coalesce(n_markets, 0) AS n_markets, coalesce(n_open, 0) AS n_open,
       coalesce(n_backfilled, 0) AS n_backfilled, coalesce(l.n, 0) AS n_snapshots, l.latest_ms, coalesce(l.r, 0) AS n_trades
FROM p LEFT JOIN m ON m.platform = p.platform LEFT JOIN l ON l.platform = p.platform""")
def platform_status_query(t):
    """Orders as markets, all their lines as snapshots, returned ones as trades."""
    m = order_markets(t)
    lines = inner_catalog(order_lines(t).select("market_id", "l_shipdate", "l_returnflag"), m, ["market_id"], ["platform"])
    return platform_status(m, lines, lines.filter("l_returnflag = 'R'"),
                           latest=F.unix_millis(F.col("l_shipdate").cast("timestamp")))


@query("coverage", _MARKETS_SQL + """
SELECT m.platform, m.event_id, CAST(count(l.l_orderkey) AS BIGINT) AS trades,
       count(l.l_orderkey) FILTER (WHERE l_returnflag = 'R') AS returned
FROM markets m LEFT JOIN lineitem l ON l.l_orderkey = m.o_orderkey GROUP BY ALL""")
def coverage_query(t):
    """Stored lines per customer and platform."""
    lines = order_lines(t)
    return coverage(order_markets(t), {"trades": lines, "returned": lines.filter("l_returnflag = 'R'")},
                    keys=["market_id"])


@query("event_markets", _MARKETS_SQL + """,
n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT m.event_id, m.market_id, coalesce(n.n, 0) AS n_trades,
       min(game_start_ts) OVER (PARTITION BY event_id) AS event_start_ts
FROM markets m LEFT JOIN n ON n.l_orderkey = m.o_orderkey""")
def event_markets_query(t):
    """Orders of every customer with their number of lines."""
    return (event_markets(order_markets(t), order_lines(t), ["market_id"], ["event_id"])
            .select("event_id", "market_id", "n_trades", "event_start_ts"))


@query("watch_tiers", _MARKETS_SQL + f"""
SELECT platform, market_id,
       CASE WHEN {NOW} BETWEEN game_start_ts - 2700 AND game_start_ts + 28800 THEN 'fast' ELSE 'slow' END AS tier
FROM markets WHERE status IN ('open', 'active')""")
def watch_tiers_query(t):
    return watch_tiers(order_markets(t), NOW).select("platform", "market_id", "tier")


# ---------------------------------------------------------------- worklist and windows

_TODO_SQL = _MARKETS_SQL + f""",
todo AS (SELECT *, coalesce(condition_id, market_id) AS task FROM markets
         WHERE backfilled = 0 AND status IN ('closed', 'settled'))
"""


@query("worklist", _TODO_SQL + "SELECT platform, market_id, task, volume, close_ts FROM todo")
def worklist(t):
    return backfill_worklist(order_markets(t)).select("platform", "market_id", "task", "volume", "close_ts")


@query("worklist_tasks", _TODO_SQL + """
SELECT platform, task, count(*) AS n_markets, round(sum(volume), 2) AS known_volume,
       count(*) FILTER (WHERE volume IS NULL) AS n_unknown, max(close_ts) AS close_ts,
       count(*) FILTER (WHERE volume IS NULL) = 0 AND sum(volume) = 0 AS skip
FROM todo GROUP BY platform, task""")
def worklist_tasks_query(t):
    tasks = worklist_tasks(with_task(order_markets(t)))
    return tasks.withColumn("known_volume", F.round("known_volume", 2))


@query("history_chunks", _TODO_SQL + f""",
own AS (SELECT l_orderkey, max(CAST(epoch(l_shipdate) AS BIGINT)) AS own_last FROM lineitem GROUP BY l_orderkey),
k AS (SELECT todo.*, own_last, max(own_last) OVER (PARTITION BY platform, task) AS task_last,
             sum(volume) OVER (PARTITION BY platform, task) AS vol,
             count(*) FILTER (WHERE volume IS NULL) OVER (PARTITION BY platform, task) AS unknown
      FROM todo LEFT JOIN own ON l_orderkey = o_orderkey),
e AS (SELECT *, coalesce(game_start_ts, {NOW}) - 604800 AS s0,
             least(coalesce(close_ts, {NOW}), {NOW}, coalesce(own_last, task_last) + 86400) AS e0 FROM k),
w AS (SELECT *, least(s0, e0) AS s, e0 AS e, unknown > 0 OR coalesce(vol, 1) <> 0 AS traded FROM e),
tiers AS (
  SELECT platform, market_id, task, 10 AS resolution, CASE WHEN e - s > 1814400 THEN greatest(s, e - 1814400) ELSE s END AS t0,
         e AS t1, 864000 AS step FROM w WHERE platform = '{TOKEN_PLATFORM}' AND traded
  UNION ALL SELECT platform, market_id, task, 1, greatest(s, game_start_ts - 3600), least(e, game_start_ts + 28800), 86400
         FROM w WHERE platform = '{TOKEN_PLATFORM}' AND traded AND game_start_ts IS NOT NULL
  UNION ALL SELECT platform, market_id, task, 1, s, e, 294000
         FROM w WHERE platform = '{TICKER_PLATFORM}' AND traded AND e - s <= 1814400
  UNION ALL SELECT platform, market_id, task, 60, s, e, 17640000
         FROM w WHERE platform = '{TICKER_PLATFORM}' AND traded AND e - s > 1814400
  UNION ALL SELECT platform, market_id, task, 1, greatest(s, e - 259200), e, 294000
         FROM w WHERE platform = '{TICKER_PLATFORM}' AND traded AND e - s > 1814400),
c AS (SELECT *, unnest(range(t0, t1, step)) AS chunk_start FROM tiers WHERE t0 < t1)
SELECT platform, market_id, task, CAST(resolution AS INTEGER) AS resolution, chunk_start,
       least(chunk_start + step, t1) AS chunk_end FROM c""")
def history_chunks_query(t):
    """Request chunks of every pending order from its dates and its lines' ship dates."""
    m = order_markets(t)
    trades = inner_catalog(order_lines(t).select("market_id", F.col("l_shipdate").alias("ts")), m,
                           ["market_id"], ["platform"])
    return history_chunks(m, trades, NOW)


@query("month_windows", """
WITH c AS (SELECT c_nationkey, min(o_orderdate) AS d0, max(o_orderdate) AS d1
           FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey),
m AS (SELECT c_nationkey, unnest(generate_series(date_trunc('month', d0), d1 + INTERVAL 29 DAY + INTERVAL 23 HOUR,
                                 INTERVAL 1 MONTH)) AS a FROM c)
SELECT c_nationkey, strftime(a, '%Y-%m-%d') AS month_start, strftime(a + INTERVAL 1 MONTH, '%Y-%m-%d') AS month_end FROM m""")
def month_windows_query(t):
    """Months from each nation's first order until 30 days after its last."""
    spans = (t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey")
             .agg(F.min("o_orderdate").alias("d0"), F.max("o_orderdate").cast("timestamp").alias("d1")))
    return (month_windows(spans, F.col("d0"), F.col("d1"), 30)
            .select("c_nationkey", F.date_format("month_start", "yyyy-MM-dd").alias("month_start"),
                    F.date_format("month_end", "yyyy-MM-dd").alias("month_end")))


# ---------------------------------------------------------------- merge rules

@query("partial_upsert", """
WITH t AS (SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_acctbal > 0),
n AS (SELECT o_custkey AS c_custkey, 'NEW' AS c_mktsegment, max(o_totalprice) AS c_acctbal FROM orders GROUP BY o_custkey)
SELECT coalesce(t.c_custkey, n.c_custkey) AS c_custkey, coalesce(t.c_mktsegment, n.c_mktsegment) AS c_mktsegment,
       coalesce(n.c_acctbal, t.c_acctbal) AS c_acctbal
FROM t FULL JOIN n ON t.c_custkey = n.c_custkey""")
def partial_upsert_query(t):
    """Customers in credit; ordering customers change only their balance, others are added."""
    stored = t("customer").filter("c_acctbal > 0").select("c_custkey", "c_mktsegment", "c_acctbal")
    loaded = (t("orders").groupBy(F.col("o_custkey").alias("c_custkey"))
              .agg(F.lit("NEW").alias("c_mktsegment"), F.max("o_totalprice").alias("c_acctbal")))
    return partial_upsert(stored, loaded, ["c_custkey"], ["c_acctbal"])


@query("set_fields", """
SELECT c_custkey, coalesce(n.seg, c_mktsegment) AS c_mktsegment, greatest(c_acctbal, n.bal) AS c_acctbal
FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) / 50 AS bal,
                                min(CASE WHEN o_orderstatus = 'P' THEN 'PENDING' END) AS seg FROM orders GROUP BY o_custkey) n
  ON c_custkey = o_custkey""")
def set_fields_query(t):
    """A NULL in the patch keeps the old value; the balance never steps back."""
    patch = (t("orders").groupBy(F.col("o_custkey").alias("c_custkey"))
             .agg((F.max("o_totalprice") / 50).alias("c_acctbal"),
                  F.min(F.when(F.col("o_orderstatus") == "P", "PENDING")).alias("c_mktsegment")))
    return set_fields(t("customer").select("c_custkey", "c_mktsegment", "c_acctbal"), patch, ["c_custkey"],
                      ["c_acctbal", "c_mktsegment"], greatest=["c_acctbal"])


# ---------------------------------------------------------------- series

_LINE_ORDER = ["l_linenumber", "l_orderkey", "l_suppkey", "l_extendedprice", "l_discount", "l_returnflag"]


@query("finest_series", """
SELECT l_partkey, ship_us, price FROM (
  SELECT l_partkey, epoch_us(l_shipdate) AS ship_us, CASE WHEN l_returnflag <> 'N' THEN l_extendedprice END AS price,
         row_number() OVER (PARTITION BY l_partkey, l_shipdate ORDER BY l_linenumber, l_orderkey, l_suppkey,
                            l_extendedprice, l_discount, l_returnflag) AS rn FROM lineitem)
WHERE rn = 1 AND price IS NOT NULL""")
def finest_series_query(t):
    """Per part and day the line of lowest number; a missing price hides the others."""
    points = (t("lineitem").withColumn("ship_us", micros(F.col("l_shipdate")))
              .withColumn("price", F.when(F.col("l_returnflag") != "N", F.col("l_extendedprice"))))
    return finest_series(points, ["l_partkey"], "ship_us", _LINE_ORDER, "price")


@query("mid_series", """
SELECT l_partkey, epoch_us(l_shipdate) AS ship_us,
       CAST(round(CAST((l_extendedprice / 200000 * (1 - l_discount) + l_extendedprice / 200000 * (1 + l_tax)) / 2 AS DECIMAL(30, 12)), 4) AS DOUBLE) AS price
FROM lineitem WHERE l_tax > 0""")
def mid_series_query(t):
    """Each line as a one-level book around its price; untaxed lines have no ask."""
    p = F.col("l_extendedprice") / 200000
    level = "array<struct<price:double,size:double>>"
    books = (t("lineitem").withColumn("ship_us", micros(F.col("l_shipdate")))
             .withColumn("bids", F.array(F.struct((p * (1 - F.col("l_discount"))).alias("price"), F.lit(1.0).alias("size"))))
             .withColumn("asks", F.when(F.col("l_tax") > 0, F.array(F.struct(
                 (p * (1 + F.col("l_tax"))).alias("price"), F.lit(1.0).alias("size")))).otherwise(F.array().cast(level))))
    return mid_series(books, ["l_partkey"], "ship_us")


# ---------------------------------------------------------------- calibration of both platforms

@query("calibration", """
WITH first AS (SELECT user_id, min(CAST(floor(epoch_us(ts) / 1e6) AS BIGINT)) AS g FROM events
               WHERE event_type = 'purchase' GROUP BY user_id),
v AS (SELECT e.user_id, e.value / 500 AS price, epoch_us(ts) AS t FROM events e WHERE event_type = 'view'),
last AS (SELECT v.user_id, arg_max(price, t) AS p FROM v JOIN first f USING (user_id)
         WHERE t <= (f.g - 3600) * 1000000 GROUP BY v.user_id),
ticker AS (SELECT 'kalshi' AS platform, p - 0.01 + 0.01 AS p, CASE WHEN user_id % 3 = 0 THEN 1.0 ELSE 0.0 END AS y
           FROM last WHERE user_id % 2 = 1),
both_tokens AS (SELECT user_id // 4 AS c FROM last WHERE user_id % 2 = 0 GROUP BY 1 HAVING count(*) >= 2),
token AS (SELECT 'polymarket' AS platform, p, CASE WHEN user_id % 4 = 0 THEN 1.0 ELSE 0.0 END AS y
          FROM last WHERE user_id % 2 = 0 AND user_id // 4 IN (SELECT c FROM both_tokens)),
pairs AS (SELECT * FROM ticker UNION ALL SELECT * FROM token),
ok AS (SELECT * FROM pairs WHERE p BETWEEN 0 AND 1),
bins AS (SELECT platform, least(CAST(floor(p * 10) AS BIGINT), 9) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS ay
         FROM ok GROUP BY ALL),
score AS (SELECT platform, count(*) AS total_n, CAST(round(CAST(avg((p - y) * (p - y)) AS DECIMAL(30, 12)), 5) AS DOUBLE) AS brier FROM ok GROUP BY platform),
frame AS (SELECT g.platform, b.bin FROM (SELECT unnest(['kalshi', 'polymarket']) AS platform) g,
                 (SELECT unnest(range(10)) AS bin) b)
SELECT f.platform, CAST(f.bin AS INTEGER) AS bin, round(CAST(f.bin AS DOUBLE) / 10, 4) AS lo,
       round(CAST(f.bin + 1 AS DOUBLE) / 10, 4) AS hi, coalesce(b.n, 0) AS n,
       CAST(round(CAST(b.mp AS DECIMAL(30, 12)), 4) AS DOUBLE) AS mean_pred, CAST(round(CAST(b.ay AS DECIMAL(30, 12)), 4) AS DOUBLE) AS obs_freq,
       coalesce(s.total_n, 0) AS total_n, s.brier
FROM frame f LEFT JOIN bins b ON b.platform = f.platform AND b.bin = f.bin LEFT JOIN score s ON s.platform = f.platform""")
def calibration_query(t):
    """Odd users as tickers (views as quoted candles), even ones as tokens in pairs; an hour before the first purchase."""
    starts = t.events("purchase").groupBy("user_id").agg(F.min("s").alias("game_start_ts"))
    odd = F.col("user_id") % 2 == 1
    paid = F.when(F.col("user_id") % 4 == 0, '["1","0"]').otherwise('["0","1"]')
    markets = starts.select(
        F.when(odd, TICKER_PLATFORM).otherwise(TOKEN_PLATFORM).alias("platform"),
        F.col("user_id").cast("string").alias("market_id"), F.lit("e").alias("event_id"), F.lit("t").alias("title"),
        F.floor(F.col("user_id") / 4).cast("string").alias("condition_id"),
        F.when(F.col("user_id") % 4 == 0, "A").otherwise("A").alias("outcome"), "game_start_ts",
        F.when(odd, "settled").otherwise("closed").alias("status"),
        F.when(odd, F.when(F.col("user_id") % 3 == 0, "yes").otherwise("no")).alias("result"),
        F.to_json(F.struct(F.lit('["A","B"]').alias("outcomes"), paid.alias("outcomePrices"))).alias("raw"))
    v = t.events("view").select("user_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("value") / 500).alias("price"))
    points = v.select(F.lit(TOKEN_PLATFORM).alias("platform"), F.col("user_id").cast("string").alias("market_id"), "ts",
                      F.lit(1).alias("fidelity"), "price")
    # Quotes one point either side of the price; the close itself is off.
    quote = F.to_json(F.struct(
        F.struct((F.col("price") - 0.01).cast("string").alias("close_dollars")).alias("yes_bid"),
        F.struct((F.col("price") + 0.01).cast("string").alias("close_dollars")).alias("yes_ask")))
    candles = v.select(F.lit(TICKER_PLATFORM).alias("platform"), F.col("user_id").cast("string").alias("market_id"), "ts",
                       F.lit(1).alias("period_min"), F.lit(0.5).alias("close"), quote.alias("raw"))
    return calibration(markets, points, candles, horizon=3600, n_bins=10)


# ---------------------------------------------------------------- export and append

@query("export_rows", """
SELECT regexp_replace('x_c ' || o_custkey, '[^A-Za-z0-9_.-]', '_', 'g') || '-' || md5('x' || chr(10) || 'c ' || o_custkey)[1:8] AS dir, CAST(l_orderkey AS VARCHAR) AS market_id,
       CAST(epoch(l_shipdate) AS BIGINT) AS ts, l_extendedprice AS price, l_quantity AS size, l_returnflag AS side
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0""")
def export_rows_query(t):
    """Trade rows of every customer in credit as exported."""
    return (export_rows(_export_tables(t), _export_events(t), NOW)["trades"][0]
            .select("dir", "market_id", "ts", "price", "size", "side"))


def _export_events(t):
    return t("customer").filter("c_acctbal > 0").select(
        F.lit("x").alias("platform"), F.concat(F.lit("c "), F.col("c_custkey")).alias("event_id"))


def _export_tables(t, event=None):
    x = F.lit("x").alias("platform")
    event = F.concat(F.lit("c "), F.col("o_custkey")) if event is None else event
    markets = t("orders").select(
        x, F.col("o_orderkey").cast("string").alias("market_id"), event.alias("event_id"),
        *[F.lit(None).cast("string").alias(c) for c in ("series", "condition_id", "title", "outcome", "result")],
        F.col("o_orderstatus").alias("status"), _seconds("o_orderdate").alias("game_start_ts"),
        F.lit(None).cast("bigint").alias("open_ts"), F.lit(None).cast("bigint").alias("close_ts"),
        F.lit(0).alias("outage_affected"))
    lines = order_lines(t).select(x, "market_id", F.col("l_shipdate").cast("timestamp").alias("ts"), "l_linenumber",
                                  "l_extendedprice", "l_quantity", "l_returnflag", "l_discount")
    price = F.col("l_extendedprice")
    level = F.array(F.struct(price.alias("price"), F.col("l_quantity").alias("size")))
    return {
        "markets": markets,
        "book_snapshots": lines.select("platform", "market_id", "ts", F.col("ts").alias("source_ts"),
                                       level.alias("bids"), level.alias("asks")),
        "trades": lines.select("platform", "market_id", "ts", F.col("l_linenumber").cast("string").alias("trade_id"),
                               price.alias("price"), F.col("l_quantity").alias("size"), F.col("l_returnflag").alias("side")),
        "candles": lines.select("platform", "market_id", "ts", F.lit(1).alias("period_min"),
                                *[price.alias(c) for c in ("open", "high", "low", "close")],
                                F.col("l_quantity").alias("volume"), F.lit(0.0).alias("open_interest")),
        "price_points": lines.select("platform", "market_id", "ts", F.lit(1).alias("fidelity"), price.alias("price")),
        "outages": t("supplier").select(x, F.lit("halt").alias("kind"), (F.lit(EARLY) + F.col("s_suppkey") * 1_000_000).alias("start_ts"),
                                        (F.lit(EARLY) + F.col("s_suppkey") * 1_000_000 + 200_000).alias("end_ts"), F.lit("n").alias("note")),
    }


@query("event_members", """
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_orderkey IN (
  SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0))""")
def event_members_query(t):
    """Lines of the orders of customers in credit."""
    m = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    events = t("customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return (event_members(t("lineitem"), m, events, ["l_orderkey"], ["o_custkey"])
            .select("l_orderkey", "l_linenumber", "l_extendedprice"))


@query("append_series", """
SELECT event_type AS platform, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, count(*) AS n,
       min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us FROM events GROUP BY ALL""")
def append_series_query(t):
    """Events written by kind and week, then read back."""
    path = scratch_path(t.spark, "series")
    e = t.events().select(F.col("event_type").alias("platform"), F.col("user_id").alias("market_id"), "ts", "value")
    append_series(e, path)
    return (t.spark.read.parquet(path).groupBy("platform", F.date_format("week", "yyyy-MM-dd").alias("week"))
            .agg(F.count(F.lit(1)).alias("n"), F.min(micros(F.col("ts"))).alias("first_us"),
                 F.max(micros(F.col("ts"))).alias("last_us")))


# ---------------------------------------------------------------- raw documents

@query("token_trades", """
SELECT sha1('|' || user_id || '|' || event_type || '|' || CAST(floor(epoch_us(ts) / 1e6) AS BIGINT) || '|' || value || '|'
            || CAST(json_extract_string(props, '$.k') AS BIGINT) || '|BUY') AS trade_id,
       event_type AS market_id, CAST(floor(epoch_us(ts) / 1e6) AS BIGINT) AS ts, value AS price,
       CAST(json_extract_string(props, '$.k') AS DOUBLE) AS size, 'buy' AS side FROM events""")
def token_trades(t):
    """Events as raw trade documents of the token exchange."""
    doc = F.to_json(F.struct(
        F.col("s").alias("timestamp"), F.col("user_id").cast("string").alias("proxyWallet"),
        F.col("event_type").alias("asset"), F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("bigint").alias("size"), F.lit("BUY").alias("side")))
    return (normalize_token_trades(t.events().select(doc.alias("value")))
            .select("trade_id", "market_id", F.unix_seconds("ts").alias("ts"), "price", "size", "side"))


@query("ticker_trades", """
SELECT l_orderkey || '-' || l_linenumber AS trade_id, CAST(l_partkey AS VARCHAR) AS market_id,
       CAST(epoch(l_shipdate) AS BIGINT) AS ts,
       CASE WHEN l_linestatus = 'F' THEN l_discount ELSE CAST(round(l_tax * 100) AS DOUBLE) / 100 END AS price,
       l_quantity AS size, '' AS side FROM lineitem""")
def ticker_trades(t):
    """Order lines as raw trade documents: prices as dollar text or whole cents."""
    done = F.col("l_linestatus") == "F"
    doc = F.to_json(F.struct(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("trade_id"),
        F.date_format(F.col("l_shipdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_time"),
        F.when(done, F.col("l_discount").cast("string")).alias("yes_price_dollars"),
        F.when(~done, F.round(F.col("l_tax") * 100).cast("int")).alias("yes_price"),
        F.when(done, F.col("l_quantity").cast("string")).alias("count_fp"),
        F.when(~done, F.col("l_quantity").cast("int")).alias("count")))
    raw = t("lineitem").select(F.col("l_partkey").cast("string").alias("market_id"), doc.alias("value"))
    return (normalize_ticker_trades(raw)
            .select("trade_id", "market_id", F.unix_seconds("ts").alias("ts"), "price", "size", "side"))


@query("raw_candles", """
SELECT CAST(l_partkey AS VARCHAR) AS market_id, CAST(epoch(l_shipdate) AS BIGINT) AS ts,
       CASE WHEN l_returnflag = 'A' THEN l_discount ELSE CAST(round(l_tax * 100) AS DOUBLE) / 100 END AS open,
       CASE WHEN l_returnflag = 'A' THEN l_discount WHEN l_returnflag = 'R' THEN CAST(round(l_tax * 100) AS DOUBLE) / 100
       END AS close, l_quantity AS volume, CAST(0 AS DOUBLE) AS open_interest FROM lineitem""")
def raw_candles(t):
    """Order lines as raw candle documents: trade prices, else the bid; null dollar keys pass on."""
    flag, cents = F.col("l_returnflag"), F.round(F.col("l_tax") * 100).cast("int")
    dollars = F.col("l_discount").cast("string")
    price = (F.when(flag == "A", F.format_string('{"open_dollars":"%s","close_dollars":"%s"}', dollars, dollars))
             .when(flag == "R", F.lit('{"open_dollars":null,"open":77}')).otherwise(F.lit("{}")))
    bid = (F.when(flag == "R", F.format_string('{"open":%d,"close":%d}', cents, cents))
           .otherwise(F.format_string('{"open":%d,"close_dollars":null,"close":5}', cents)))
    doc = F.format_string('{"end_period_ts":%d,"price":%s,"yes_bid":%s,"volume_fp":"%s"}', _seconds("l_shipdate"), price, bid,
                          F.col("l_quantity").cast("string"))
    raw = t("lineitem").select(F.col("l_partkey").cast("string").alias("market_id"), F.lit(1).alias("period_min"),
                               doc.alias("value"))
    return (normalize_candles(raw)
            .select("market_id", F.unix_seconds("ts").alias("ts"), "open", "close", "volume", "open_interest"))


@query("books_twosided", """
SELECT CAST(l_partkey AS VARCHAR) AS market_id, CAST(epoch_ms(l_shipdate) AS BIGINT) AS source_ms,
       greatest(l_discount, l_tax) AS best_bid, least(l_discount, l_tax) AS worst_bid,
       least(l_discount, l_quantity) AS best_ask FROM lineitem""")
def books_twosided(t):
    """Order lines as raw books with two levels a side, out of order."""
    d, x, q = F.col("l_discount"), F.col("l_tax"), F.col("l_quantity")

    def level(p):
        return F.struct(p.cast("string").alias("price"), q.cast("string").alias("size"))

    doc = F.to_json(F.struct(
        F.col("l_partkey").cast("string").alias("asset_id"),
        F.unix_millis(F.col("l_shipdate").cast("timestamp")).cast("string").alias("timestamp"),
        F.array(level(d), level(x)).alias("bids"), F.array(level(q), level(d)).alias("asks")))
    raw = t("lineitem").select(doc.alias("value"), F.col("l_shipdate").cast("timestamp").alias("capture_ts"))
    return normalize_books_twosided(raw).select(
        "market_id", F.unix_millis("source_ts").alias("source_ms"), F.get("bids", F.lit(0))["price"].alias("best_bid"),
        F.get("bids", F.lit(1))["price"].alias("worst_bid"), F.get("asks", F.lit(0))["price"].alias("best_ask"))


@query("books_yes_no", """
SELECT CAST(l_partkey AS VARCHAR) AS market_id, l_discount AS best_bid,
       round(1 - CASE WHEN l_linestatus = 'F' THEN greatest(l_discount, l_tax) ELSE CAST(round(l_tax * 100) AS DOUBLE) / 100 END, 4)
         AS best_ask, l_quantity AS ask_size FROM lineitem""")
def books_yes_no(t):
    """Order lines as raw YES and NO bids, in dollars or (NO side of open lines) cents."""
    d, x, q = F.col("l_discount").cast("string"), F.col("l_tax").cast("string"), F.col("l_quantity").cast("string")
    cents = F.round(F.col("l_tax") * 100).cast("int")
    no = (F.when(F.col("l_linestatus") == "F", F.format_string('"no_dollars":[["%s","%s"],["%s","%s"]]', d, q, x, q))
          .otherwise(F.format_string('"no_dollars":[],"no":[[%d,%s]]', cents, q)))
    doc = F.format_string('{"orderbook_fp":{"yes_dollars":[["%s","%s"]],%s}}', d, q, no)
    raw = t("lineitem").select(F.col("l_partkey").cast("string").alias("market_id"), doc.alias("value"),
                               F.col("l_shipdate").cast("timestamp").alias("capture_ts"))
    return normalize_books_yes_no(raw).select(
        "market_id", F.get("bids", F.lit(0))["price"].alias("best_bid"), F.get("asks", F.lit(0))["price"].alias("best_ask"),
        F.get("asks", F.lit(0))["size"].alias("ask_size"))


@query("token_markets", """
WITH k AS (SELECT *, unnest([0, 1]) AS i FROM orders WHERE o_orderstatus <> 'P')
SELECT o_orderkey || CASE i WHEN 0 THEN 'a' ELSE 'b' END AS market_id, 'ev-' || o_custkey AS event_id,
       CASE WHEN i = 0 THEN o_orderpriority ELSE '1' END AS outcome,
       CASE WHEN o_orderstatus = 'F' THEN CAST(epoch(o_orderdate) AS BIGINT) ELSE CAST(epoch(o_orderdate) AS BIGINT) - 19800 END
         AS game_start_ts, CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open' END AS status FROM k""")
def token_markets(t):
    """Orders as raw events with one two-token market; pending ones have no order book."""
    day = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    done = F.col("o_orderstatus") == "F"
    tokens = F.to_json(F.array(F.concat("o_orderkey", F.lit("a")), F.concat("o_orderkey", F.lit("b"))))
    market = F.struct(
        tokens.alias("clobTokenIds"), F.array(F.col("o_orderpriority")).alias("outcomes"),
        (F.col("o_orderstatus") != "P").alias("enableOrderBook"), done.alias("closed"),
        F.when(done, F.concat(day, F.lit("+00"))).alias("gameStartTime"))
    doc = F.to_json(F.struct(F.concat(F.lit("ev-"), F.col("o_custkey")).alias("slug"),
                             F.concat(day, F.lit("+05:30")).alias("startTime"), F.array(market).alias("markets")))
    return (normalize_token_markets(t("orders").select(doc.alias("value")))
            .select("market_id", "event_id", "outcome", "game_start_ts", "status"))


_EASTERN_SQL = """
WITH d AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, o_orderdate + INTERVAL 30 YEAR AS day FROM orders),
z AS (SELECT *, strftime(day, '%y') || upper(strftime(day, '%b')) || strftime(day, '%d') AS code,
             make_date(year(day), 3, 8) AS m, make_date(year(day), 11, 1) AS n FROM d),
e AS (SELECT *, m + CAST((7 - dayofweek(m)) % 7 AS INTEGER) AS spring, n + CAST((7 - dayofweek(n)) % 7 AS INTEGER) AS autumn FROM z)
"""


def _dated(t):
    """Orders thirty years on, when tickers exist."""
    return t("orders").withColumn("day", F.add_months(F.to_date("o_orderdate"), 360))


def _code():
    return F.concat(F.date_format("day", "yy"), F.upper(F.date_format("day", "MMM")), F.date_format("day", "dd"))


@query("ticker_markets", _EASTERN_SQL + """
SELECT 'KX-' || code || '1830' || o_orderkey || '-Y' AS market_id, 'KX-' || code || '1830' || o_orderkey AS event_id,
       o_orderpriority AS outcome, CAST(epoch(day) AS BIGINT) + 66600
         + CASE WHEN day >= spring AND day < autumn THEN 14400 ELSE 18000 END AS game_start_ts, o_orderstatus AS status FROM e""")
def ticker_markets(t):
    """Orders as raw ticker markets; the start (18:30 US Eastern) is part of the ticker."""
    event = F.concat(F.lit("KX-"), _code(), F.lit("1830"), F.col("o_orderkey"))
    doc = F.to_json(F.struct(F.concat(event, F.lit("-Y")).alias("ticker"), event.alias("event_ticker"),
                             F.col("o_orderpriority").alias("yes_sub_title"), F.col("o_orderstatus").alias("status")))
    return (normalize_ticker_markets(_dated(t).select(doc.alias("value"), F.lit("KX").alias("series")))
            .select("market_id", "event_id", "outcome", "game_start_ts", "status"))


@query("exchange_status", """
SELECT event_id, CAST(floor(epoch_us(ts) / 1e6) AS BIGINT) AS ts,
       CASE WHEN event_type <> 'error' THEN value > 10 AND CAST(json_extract_string(props, '$.k') AS BIGINT) > 10 END AS active
FROM events""")
def exchange_status(t):
    """Events as raw status documents; errors are failed polls."""
    k = F.get_json_object("props", "$.k").cast("bigint")

    def part(index, trading):
        return F.struct(index.alias("exchange_index"), trading.alias("trading_active"), F.lit(True).alias("exchange_active"))

    doc = F.to_json(F.struct(F.lit(True).alias("exchange_active"), (F.col("value") > 10).alias("trading_active"),
                             F.array(part(F.lit(1), F.lit(False)), part(F.lit(0), k > 10)).alias("exchange_index_statuses")))
    polls = t.events().select("event_id", F.struct("event_id", "s").alias("ts"),
                              F.when(F.col("event_type") != "error", doc).alias("value"))
    return normalize_exchange_status(polls).select("ts.event_id", F.col("ts.s").alias("ts"), "active")


@query("maintenance", """
SELECT CAST(floor(epoch_us(ts) / 1e6) AS BIGINT) AS start_ts,
       CASE WHEN event_type = 'click' THEN CAST(floor(epoch_us(ts) / 1e6) AS BIGINT) + 3600 END AS end_ts
FROM events WHERE event_type IN ('click', 'view')""")
def maintenance(t):
    """Events as raw schedules: clicks end after an hour, views stay open, others have no start."""
    def iso(c):
        return F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")

    window = F.struct(F.when(F.col("event_type") == "click", iso(F.col("s"))).alias("start_datetime"),
                      F.when(F.col("event_type") == "view", iso(F.col("s"))).alias("start_time"),
                      F.when(F.col("event_type") == "click", iso(F.col("s") + 3600)).alias("end_time"))
    doc = F.to_json(F.struct(F.struct(F.array(window).alias("maintenance_windows")).alias("schedule")))
    return normalize_maintenance(t.events().select(doc.alias("value"))).select("start_ts", "end_ts")


@query("parse_times", """
SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS z, CAST(epoch(o_orderdate) AS BIGINT) - 19800 AS half,
       CAST(epoch(o_orderdate) AS BIGINT) AS ms, CAST(NULL AS BIGINT) AS bare FROM orders""")
def parse_times(t):
    """Order dates written as UTC, with an offset, as milliseconds and as bare dates."""
    date = F.col("o_orderdate").cast("timestamp")
    text = F.date_format(date, "yyyy-MM-dd'T'HH:mm:ss")
    # Dates before September 2001 have fewer than thirteen digits in ms and read as seconds otherwise.
    ms = F.when(F.unix_millis(date) > 1e12, F.unix_millis(date)).otherwise(F.unix_seconds(date)).cast("string")
    return t("orders").select(
        "o_orderkey", parse_ts(F.concat(text, F.lit(".25Z"))).alias("z"), parse_ts(F.concat(text, F.lit("+0530"))).alias("half"),
        parse_ts(ms).alias("ms"), parse_ts(F.date_format(date, "yyyy-MM-dd")).alias("bare"))


@query("team_names", """
SELECT p_partkey, regexp_replace(lower(p_name), ' +', ' ', 'g') AS name FROM part""")
def team_names(t):
    """Names with suffixes and punctuation added compare as before."""
    return t("part").select("p_partkey", norm_team(F.concat(F.lit("Team "), F.upper("p_name"), F.lit("-Esports!"))).alias("name"))


@query("ticker_times", _EASTERN_SQL + """
SELECT o_orderkey, CAST(epoch(day) AS BIGINT) + 9000
       + CASE WHEN day > spring AND day < autumn THEN 14400 ELSE 18000 END AS start_ts FROM e""")
def ticker_times(t):
    """Every order date as a ticker at 02:30 US Eastern, a time the spring change skips."""
    ticker = F.concat(F.lit("X-"), _code(), F.lit("0230AB"))
    return _dated(t).select("o_orderkey", ticker_start(ticker).alias("start_ts"))


# ---------------------------------------------------------------- match statistics

def _match_columns():
    """Columns of a match row that all rows of an order line share, and those of its team and its player row."""
    common = [F.col("l_orderkey").cast("string").alias("gameid"), F.col("o_orderpriority").alias("league"),
              F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("date"),
              F.lit("1.0").alias("game"), F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy").alias("patch"),
              F.when(F.col("l_linestatus") == "F", "Blue").otherwise("Red").alias("side"),
              F.when(F.col("l_linestatus") == F.col("o_orderstatus"), "1").otherwise("0").alias("result"),
              F.concat(F.lit("T"), "l_linestatus").alias("teamname")]
    slot = (F.col("l_linenumber") - 1) % 5 + 1
    nothing = F.lit(None).cast("string")
    team = [F.lit("team").alias("position"), nothing.alias("champion"),
            *[F.when(slot == i, F.concat(F.lit(" "), "p_brand")).alias(f"pick{i}") for i in range(1, 6)],
            *[F.when(slot == i, F.col("p_type")).alias(f"ban{i}") for i in range(1, 6)]]
    player = [F.col("l_returnflag").alias("position"), F.col("p_brand").alias("champion"),
              *[nothing.alias(f"{k}{i}") for k in ("pick", "ban") for i in range(1, 6)]]
    return common, team, player


def match_csv(t):
    """Order lines as match rows: a player row per line, and a team row per line holding it as pick and ban."""
    j = (t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
         .join(t("part"), F.col("l_partkey") == F.col("p_partkey")))
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_quantity",
                   "l_returnflag")
    common, team, player = _match_columns()
    placed = [*common, F.lit("f").alias("file"), row.alias("row")]
    return j.select(*placed, *team).unionByName(j.select(*placed, *player))


def match_loads(t, lines_per_part: int = 50_000):
    """The same rows in two loads ``a`` and ``b``, the second with other winners and a day later; each leaves out a third of the games.

    Lines are joined once and dealt out by game while they are narrow; rows are made of them where they
    then lie. A game's rows are in one partition, and a partition's share does not grow with the input.
    """
    parts = t("lineitem").count() // lines_per_part + 1
    lines = (t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
             .select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "p_brand", "p_type"))
    orders = t("orders").select("o_orderkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    # Both sides are dealt out alike, so the join shuffles neither of them again.
    j = lines.repartition(parts, "l_orderkey").join(orders.repartition(parts, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    left_out = F.col("l_orderkey") % 3
    j = j.withColumn("load", F.explode(F.array_compact(F.array(F.when(left_out != 0, "a"), F.when(left_out != 1, "b")))))
    common, team, player = _match_columns()
    rows = j.select("load", *common, F.inline(F.array(F.struct(*team), F.struct(*player))))
    second = F.col("load") == "b"
    day_later = F.date_format(F.to_timestamp("date") + F.expr("INTERVAL 1 DAY"), "yyyy-MM-dd HH:mm:ss")
    turned = F.when(F.col("side") == "Red", "1").otherwise("0")
    return (rows.withColumn("date", F.when(second, day_later).otherwise(F.col("date")))
            .withColumn("result", F.when(second, turned).otherwise(F.col("result"))))


_LINES_SQL = """
WITH j AS (SELECT *, CAST(l_orderkey AS VARCHAR) AS game_id, 'T' || l_linestatus AS team, (l_linenumber - 1) % 5 + 1 AS slot,
                  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice,
                                     l_discount, l_tax, l_quantity, l_returnflag) AS rn
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)
"""


@query("match_games", _LINES_SQL + """
SELECT game_id, min(o_orderpriority) AS league, min(CAST(epoch(o_orderdate) AS BIGINT)) AS date_utc,
       CAST(1 AS INTEGER) AS game_num, min(strftime(o_orderdate, '%Y')) AS patch,
       max(CASE WHEN l_linestatus = 'F' THEN team END) AS blue_team, max(CASE WHEN l_linestatus <> 'F' THEN team END) AS red_team,
       max(CASE WHEN l_linestatus = o_orderstatus THEN team END) AS winner FROM j GROUP BY game_id""")
def match_games_query(t):
    return match_games(match_csv(t))


@query("unpivot_picks", _LINES_SQL + """
SELECT game_id, team, p_brand AS champion, arg_max(l_returnflag, rn) AS position, CAST(arg_max(slot, rn) AS INTEGER) AS pick_order
FROM j GROUP BY ALL""")
def unpivot_picks(t):
    """Roles from player rows merged with the order from the numbered columns of team rows."""
    return match_picks(match_csv(t))


@query("unpivot_bans", _LINES_SQL + """
SELECT game_id, team, p_type AS champion, CAST(arg_min(slot, rn) AS INTEGER) AS ban_order FROM j GROUP BY ALL""")
def unpivot_bans(t):
    return match_bans(match_csv(t))
