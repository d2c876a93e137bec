"""Events as market ticks: as-of prices, calibration, series, halts and merges.

A user is a market, an event a tick, the value/500 its price; purchases are games.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.asof import asof_backward, asof_cutoff, nearest
from ..operators.calibration import brier, paired_conditions, reliability_bins
from ..operators.deltas import odds_around
from ..operators.history import chunk_expand, coverage_gaps, range_gaps
from ..operators.intervals import (flag_outages, halts_from_status, interval_overlap, ongoing_start,
                                   recent_outages)
from ..operators.merge import (close_open_intervals, coalesce_merge, insert_if_absent, last_write_wins)
from ..operators.ordered import find_cuts
from ..operators.scoring import prefix_sets
from ..operators.series import (bucket_last, change_only, latest_per_key, newest_trade_mark, series_choice,
                                trade_series)
from .registry import query

#: 2024-02-01, the time at which open halts are cut off.
NOW = 1706745600

_PAIRS_SQL = """
WITH v AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view'),
pairs AS (
  SELECT p.user_id % 2 AS platform, v.value / 500 AS p,
         CASE WHEN CAST(json_extract_string(p.props, '$.k') AS BIGINT) < 50 THEN 1 ELSE 0 END AS y
  FROM events p ASOF JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts
  WHERE p.event_type = 'purchase')
"""


def _views(t):
    """Views as ticks. Ties prefer the smallest value, so the later event is negated."""
    return t.events("view").select("user_id", F.col("t").alias("tick_t"), "value",
                                   (-F.col("event_id")).alias("tie"))


def calibration_sample(t):
    """(platform, p, y) of each purchase: the user's last viewed price and the purchase's outcome."""
    probes = t.events("purchase").select(
        "user_id", "event_id", "t",
        F.when(F.get_json_object("props", "$.k").cast("bigint") < 50, 1).otherwise(0).alias("y"))
    found = asof_backward(probes, _views(t), ["user_id"], "t", "tick_t", ["value"], tie="tie")
    return (found.filter(F.col("value").isNotNull())
            .select((F.col("user_id") % 2).alias("platform"), (F.col("value") / 500).alias("p"), "y"))


@query("calibration_bins", _PAIRS_SQL + """,
frame AS (SELECT g.platform, b.bin FROM (SELECT unnest([0, 1]) AS platform) g, (SELECT unnest(range(100)) AS bin) b),
stats AS (
  SELECT platform, least(CAST(floor(p * 100) AS BIGINT), 99) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS ay
  FROM pairs WHERE p BETWEEN 0 AND 1 GROUP BY ALL)
SELECT CAST(f.platform AS BIGINT) AS platform, CAST(f.bin AS INTEGER) AS bin,
       round(CAST(f.bin AS DOUBLE) / 100, 4) AS lo, round(CAST(f.bin + 1 AS DOUBLE) / 100, 4) AS hi,
       coalesce(s.n, 0) AS n, CAST(round(CAST(s.mp AS DECIMAL(30, 12)), 4) AS DOUBLE) AS mean_pred, CAST(round(CAST(s.ay AS DECIMAL(30, 12)), 4) AS DOUBLE) AS obs_freq
FROM frame f LEFT JOIN stats s ON f.platform = s.platform AND f.bin = s.bin""")
def calibration_bins(t):
    return reliability_bins(calibration_sample(t), [0, 1])


@query("brier_by_group", _PAIRS_SQL + """
SELECT CAST(platform AS BIGINT) AS platform, count(*) AS n, CAST(round(CAST(avg((p - y) * (p - y)) AS DECIMAL(30, 12)), 5) AS DOUBLE) AS brier
FROM pairs WHERE p BETWEEN 0 AND 1 GROUP BY platform""")
def brier_by_group(t):
    return brier(calibration_sample(t), [0, 1])


_ASOF_SQL = """
SELECT p.user_id, p.event_id, {value} AS value, {at} AS tick_us
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'view') v
  ON p.user_id = v.user_id AND p.ts >= v.ts"""


def _asof(t, **kw):
    probes = t.events("purchase").select("user_id", "event_id", "t")
    return (asof_backward(probes, _views(t), ["user_id"], "t", "tick_t", ["value"], at="tick_us", tie="tie", **kw)
            .select("user_id", "event_id", "value", "tick_us"))


@query("asof_price", _ASOF_SQL.format(value="v.value", at="epoch_us(v.ts)"))
def asof_price(t):
    return _asof(t)


_FRESH = "CASE WHEN epoch_us(v.ts) >= epoch_us(p.ts) - 21600000000 THEN {} END"


@query("asof_price_fresh", _ASOF_SQL.format(value=_FRESH.format("v.value"), at=_FRESH.format("epoch_us(v.ts)")))
def asof_price_fresh(t):
    """As above, but a price older than six hours does not count."""
    return _asof(t, earliest=F.col("t") - 21_600_000_000)


@query("asof_cutoff", """
WITH c AS (SELECT user_id, min(epoch_us(ts)) - 3600000000 AS cutoff FROM events
           WHERE event_type = 'purchase' GROUP BY user_id),
j AS (SELECT v.user_id, v.value, epoch_us(v.ts) AS t,
             row_number() OVER (PARTITION BY v.user_id ORDER BY v.ts DESC, v.event_id DESC) AS rn
      FROM events v JOIN c ON v.user_id = c.user_id AND epoch_us(v.ts) <= c.cutoff WHERE v.event_type = 'view')
SELECT user_id, value, t AS tick_us FROM j WHERE rn = 1""")
def asof_cutoff_query(t):
    """One cutoff per user: an hour before the first purchase."""
    cutoffs = t.events("purchase").groupBy("user_id").agg((F.min("t") - 3_600_000_000).alias("cutoff"))
    # The tie prefers the smallest value, so the later event is negated.
    ticks = t.events("view").select("user_id", "t", "value", (-F.col("event_id")).alias("tie"))
    return asof_cutoff(ticks, cutoffs, ["user_id"], "cutoff", "t", ["value"], tie="tie", at="tick_us")


@query("nearest_match", """
WITH m AS (
  SELECT p.event_id, p.user_id, s.event_id AS signup_id, abs(epoch_us(s.ts) - epoch_us(p.ts)) AS distance
  FROM events p JOIN events s ON p.user_id = s.user_id
  WHERE p.event_type = 'purchase' AND s.event_type = 'signup'
    AND abs(epoch_us(s.ts) - epoch_us(p.ts)) <= 43200000000)
SELECT event_id, user_id, signup_id, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY distance, signup_id) AS rn FROM m) WHERE rn = 1""")
def nearest_match(t):
    """Each purchase with the user's nearest signup within twelve hours."""
    probes = t.events("purchase").select("user_id", "event_id", "t")
    targets = t.events("signup").select("user_id", F.col("event_id").alias("signup_id"), F.col("t").alias("st"))
    return (nearest(probes, targets, ["user_id"], "t", "st", ["signup_id"], tie="signup_id",
                    tolerance=43_200_000_000).select("event_id", "user_id", "signup_id", "distance"))


@query("odds_around_start", """
WITH v AS (SELECT user_id, epoch_us(ts) AS t, value FROM events WHERE event_type = 'view'),
p AS (SELECT event_id, user_id, CAST(floor(epoch_us(ts) / 1e6) AS BIGINT) AS s FROM events WHERE event_type = 'purchase'),
a AS (SELECT p.*, v.value AS pre_p FROM (SELECT *, (s - 960) * 1000000 AS x FROM p) p
      ASOF JOIN v ON p.user_id = v.user_id AND p.x >= v.t),
b AS (SELECT p.event_id, v.value AS post_p FROM (SELECT *, (s + 120) * 1000000 AS x FROM p) p
      ASOF JOIN v ON p.user_id = v.user_id AND p.x >= v.t WHERE v.t >= (s - 960) * 1000000)
SELECT p.event_id, a.pre_p, b.post_p FROM p LEFT JOIN a USING (event_id) LEFT JOIN b USING (event_id)""")
def odds_around_start(t):
    """Last price 16 minutes before and 2 minutes after each purchase, in one pass."""
    users = t.events("purchase").select("user_id", "event_id", "s")
    ticks = t.events("view").select(
        F.lit("x").alias("platform"), F.col("user_id").alias("market_id"), F.timestamp_micros("t").alias("ts"),
        F.lit(1).alias("resolution"), F.col("value").alias("p"))
    g = users.select(F.lit("x").alias("platform"), F.col("user_id").alias("market_id"), "event_id",
                     F.col("s").alias("game_start"))
    return (odds_around(g, ticks, extra=["event_id"]).select("event_id", "pre_p", "post_p"))


# ---------------------------------------------------------------- halts

_HALTS_SQL = """
WITH e AS (SELECT user_id, epoch_us(ts) AS t, event_id, event_type <> 'error' AS active FROM events),
c AS (SELECT *, lag(active) OVER (PARTITION BY user_id ORDER BY t, event_id) AS was FROM e),
x AS (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS nxt
      FROM c WHERE active <> coalesce(was, true)),
halts AS (SELECT user_id, t AS start_us, nxt AS end_us FROM x WHERE NOT active)
"""


def user_halts(t):
    """A user is halted from an error until the next other event."""
    polls = t.events().select("user_id", "t", "event_id", (F.col("event_type") != "error").alias("active"))
    return halts_from_status(polls, ["user_id"], ["t", "event_id"], "active", "start_us", "end_us")


def _seconds(halts):
    def down(c):
        return F.floor(F.col(c) / 1_000_000).cast("bigint")
    return halts.select("user_id", down("start_us").alias("start_ts"), down("end_us").alias("end_ts"))


@query("halts", _HALTS_SQL + "SELECT user_id, start_us, end_us FROM halts")
def halts(t):
    return user_halts(t)


@query("ongoing_halt", _HALTS_SQL + """
SELECT user_id, max(start_us) AS start_us FROM halts WHERE end_us IS NULL GROUP BY user_id""")
def ongoing_halt(t):
    return ongoing_start(user_halts(t), ["user_id"], "start_us", "end_us")


@query("recent_halts", _HALTS_SQL + """
SELECT user_id, start_us, end_us FROM halts ORDER BY start_us DESC, user_id LIMIT 10""")
def recent_halts(t):
    """The ten latest halts."""
    return recent_outages(user_halts(t), [F.col("start_us").desc(), "user_id"], 10)


@query("close_halts", _HALTS_SQL + """
, last AS (SELECT user_id, max(epoch_us(ts)) AS at FROM events GROUP BY user_id)
SELECT h.user_id, h.start_us, coalesce(h.end_us, l.at) AS end_us FROM halts h JOIN last l USING (user_id)""")
def close_halts(t):
    """Open halts are closed at the user's last event."""
    last = t.events().groupBy("user_id").agg(F.max("t").alias("end_us"))
    return close_open_intervals(user_halts(t), last, ["user_id"], "end_us")


_OVERLAP_SQL = _HALTS_SQL + f""",
h AS (SELECT user_id, CAST(floor(start_us / 1e6) AS BIGINT) AS start_ts,
             CAST(floor(end_us / 1e6) AS BIGINT) AS end_ts FROM halts),
g AS (SELECT event_id, user_id, CAST(floor(epoch_us(ts) / 1e6) AS BIGINT) AS game_start_ts
      FROM events WHERE event_type = 'purchase'),
o AS (SELECT g.event_id, g.user_id, h.start_ts, h.end_ts FROM g JOIN h
      ON g.user_id = h.user_id AND h.start_ts <= g.game_start_ts + 28800
      AND coalesce(h.end_ts, {NOW}) >= g.game_start_ts - 2700)
"""


def _games(t):
    return t.events("purchase").select("event_id", "user_id", F.col("s").alias("game_start_ts"))


@query("outage_overlap", _OVERLAP_SQL + "SELECT event_id, user_id, start_ts, end_ts FROM o")
def outage_overlap(t):
    """Halts overlapping the window around each purchase."""
    return (interval_overlap(_games(t), _seconds(user_halts(t)), ["user_id"], "game_start_ts", NOW)
            .select("event_id", "user_id", "start_ts", "end_ts"))


@query("outage_flags", _OVERLAP_SQL + """
SELECT g.event_id, CAST(EXISTS (SELECT 1 FROM o WHERE o.event_id = g.event_id) AS INTEGER) AS outage_affected FROM g""")
def outage_flags(t):
    flagged = flag_outages(_games(t).withColumn("outage_affected", F.lit(0)), _seconds(user_halts(t)), NOW,
                           on=["user_id"], key=["event_id"])
    return flagged.select("event_id", "outage_affected")


# ---------------------------------------------------------------- series

@query("change_only", """
SELECT event_id, user_id, sha1(event_type) AS hash FROM (
  SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events)
WHERE event_type IS DISTINCT FROM was""")
def change_only_query(t):
    books = t.events().select("event_id", "user_id", "t", F.sha1("event_type").alias("hash"))
    return change_only(books, ["user_id"], ["t", "event_id"], "hash").select("event_id", "user_id", "hash")


@query("latest_hash", """
SELECT user_id, sha1(event_type) AS hash FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def latest_hash(t):
    books = t.events().select("event_id", "user_id", "t", F.sha1("event_type").alias("hash"))
    return latest_per_key(books, ["user_id"], ["t", "event_id"], ["hash"])


@query("bucket_last", """
SELECT user_id, bucket_ts, value, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, bucket_ts ORDER BY ts DESC, event_id DESC) AS rn FROM (
    SELECT *, CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS bucket_ts FROM events)) WHERE rn = 1""")
def bucket_last_query(t):
    """Last value and kind per user and hour."""
    return bucket_last(t.events(), ["user_id"], "t", 3600, ["value", "event_type"], seq="event_id")


@query("trade_series", "SELECT user_id, epoch_us(ts) AS t, value FROM events WHERE value IS NOT NULL")
def trade_series_query(t):
    return trade_series(t.events(), ["user_id"], "t", "value")


@query("trade_mark", """
SELECT user_id, max(CAST(floor(epoch_us(ts) / 1e6) AS BIGINT)) AS last_trade_ts,
       greatest(0, max(CAST(floor(epoch_us(ts) / 1e6) AS BIGINT)) - 60) AS cutoff_ts FROM events GROUP BY user_id""")
def trade_mark(t):
    return newest_trade_mark(t.events(), ["user_id"], "s")


@query("series_choice", """
WITH e AS (SELECT user_id, CAST(floor(epoch_us(ts) / 86400e6) AS BIGINT) AS day, epoch_us(ts) AS ts, value AS price,
                  event_type FROM events),
s AS (SELECT user_id, day, ts, price, CASE event_type WHEN 'signup' THEN 'price' ELSE 'mid' END AS kind
      FROM e WHERE event_type IN ('signup', 'error'))
SELECT * FROM s UNION ALL
SELECT user_id, day, ts, price, 'trades' FROM e WHERE event_type = 'purchase'
  AND (user_id, day) NOT IN (SELECT (user_id, day) FROM s)""")
def series_choice_query(t):
    """Per user and day: signups as prices, errors as midpoints, purchases as trades."""
    def part(kind):
        return t.events(kind).select("user_id", F.floor(F.col("t") / 86_400_000_000).cast("bigint").alias("day"),
                                     F.col("t").alias("ts"), F.col("value").alias("price"))
    return series_choice(part("signup"), part("error"), part("purchase"), ["user_id", "day"])


@query("step_prefix", """
SELECT event_id, user_id, day, row_number() OVER w AS step,
       array_to_string(list_sort(list_distinct(list(event_type) OVER w)), ',') AS seen
FROM (SELECT *, CAST(floor(epoch_us(ts) / 86400e6) AS BIGINT) AS day FROM events)
WINDOW w AS (PARTITION BY user_id, day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def step_prefix(t):
    """Running position and set of kinds seen per user and day."""
    e = t.events().select("event_id", "user_id", "t", "event_type",
                          F.floor(F.col("t") / 86_400_000_000).cast("bigint").alias("day"))
    cuts = find_cuts(e, ["user_id", "day"], ["t", "event_id"])
    seen = prefix_sets(e, ["user_id", "day"], ["t", "event_id"], "event_type", cuts=cuts)
    return seen.select("event_id", "user_id", "day", "step", F.array_join("seen", ",").alias("seen"))


# ---------------------------------------------------------------- merge rules

@query("catalog_merge", """
WITH e AS (SELECT user_id, epoch_us(ts) AS t, event_id, event_type,
                  CASE WHEN event_type <> 'error' THEN value END AS value,
                  CASE WHEN event_type = 'signup' THEN props END AS props FROM events)
SELECT user_id, arg_max(value, t) FILTER (value IS NOT NULL) AS value, arg_max(event_type, t) AS event_type,
       arg_max(props, t) FILTER (props IS NOT NULL) AS props, min(t) AS first_seen_ts, max(t) AS last_seen_ts
FROM e GROUP BY user_id""")
def catalog_merge(t):
    """Per user the newest known value, kind and signup properties."""
    log = t.events().select(
        "user_id", "t", "event_id", "event_type",
        F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
        F.when(F.col("event_type") == "signup", F.col("props")).alias("props"))
    return coalesce_merge(log, ["user_id"], ["t", "event_id"], ["value", "event_type", "props"], seen="t", raw="props")


@query("insert_if_absent", """
WITH i AS (SELECT *, CAST(floor(epoch_us(ts) / 86400e6) AS BIGINT) AS day FROM events),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY ts, event_id) AS rn
      FROM i WHERE event_type IN ('view', 'click'))
SELECT user_id, day, event_id, value FROM f WHERE rn = 1 AND NOT EXISTS (
  SELECT 1 FROM i p WHERE p.event_type = 'purchase' AND p.user_id = f.user_id AND p.day = f.day)""")
def insert_if_absent_query(t):
    """First view or click per user and day, unless the day already has a purchase."""
    def daily(*kinds):
        return t.events(*kinds).withColumn("day", F.floor(F.col("t") / 86_400_000_000).cast("bigint"))
    return (insert_if_absent(daily("view", "click"), ["user_id", "day"], ["t", "event_id"], daily("purchase"))
            .select("user_id", "day", "event_id", "value"))


@query("last_write_wins", """
SELECT user_id, event_type, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn = 1""")
def last_write_wins_query(t):
    return (last_write_wins(t.events(), ["user_id", "event_type"], ["t", "event_id"])
            .select("user_id", "event_type", "event_id", "value"))


@query("paired_only", """
SELECT event_id, user_id FROM events WHERE event_type = 'signup' AND user_id IN (
  SELECT user_id FROM events WHERE event_type = 'signup' GROUP BY user_id HAVING count(*) >= 2)""")
def paired_only(t):
    """Signups of users with at least two of them."""
    return paired_conditions(t.events("signup").select("event_id", "user_id"), "user_id")


# ---------------------------------------------------------------- gaps

@query("coverage_gaps", """
WITH b AS (SELECT user_id, min(CAST(floor(epoch_us(ts) / 86400e6) AS BIGINT)) AS d0,
                  max(CAST(floor(epoch_us(ts) / 86400e6) AS BIGINT)) AS d1 FROM events GROUP BY user_id),
c AS (SELECT user_id, unnest(range(d0, d1 + 1)) AS d FROM b)
SELECT user_id, d * 86400 AS chunk_start FROM c WHERE NOT EXISTS (
  SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.user_id = c.user_id
  AND CAST(floor(epoch_us(p.ts) / 86400e6) AS BIGINT) = c.d)""")
def coverage_gaps_query(t):
    """Days between a user's first and last event without a purchase."""
    e = t.events()
    day = F.floor(F.col("s") / 86400).cast("bigint")
    chunks = (e.groupBy("user_id").agg(F.min(day).alias("d0"), F.max(day).alias("d1"))
              .select("user_id", F.explode(F.sequence("d0", "d1")).alias("d"))
              .select("user_id", (F.col("d") * 86400).alias("chunk_start")))
    return coverage_gaps(chunks, t.events("purchase"), ["user_id"], "s", 86400)


@query("range_gaps", """
WITH b AS (SELECT user_id, min(CAST(floor(epoch_us(ts) / 1e6) AS BIGINT)) AS t0,
                  max(CAST(floor(epoch_us(ts) / 1e6) AS BIGINT)) AS t1 FROM events GROUP BY user_id HAVING t0 < t1),
c AS (SELECT user_id, unnest(range(t0, t1, 21600)) AS chunk_start, t1 FROM b),
d AS (SELECT user_id, chunk_start, least(chunk_start + 21600, t1) AS chunk_end FROM c)
SELECT user_id, chunk_start, chunk_end FROM d WHERE NOT EXISTS (
  SELECT 1 FROM events p WHERE p.event_type = 'view' AND p.user_id = d.user_id
  AND CAST(floor(epoch_us(p.ts) / 1e6) AS BIGINT) >= d.chunk_start
  AND CAST(floor(epoch_us(p.ts) / 1e6) AS BIGINT) < d.chunk_end)""")
def range_gaps_query(t):
    """Six-hour chunks of a user's life without a view."""
    life = (t.events().groupBy("user_id").agg(F.min("s").alias("t0"), F.max("s").alias("t1"))
            .withColumn("step", F.lit(21600).cast("bigint")))
    chunks = chunk_expand(life).select("user_id", "chunk_start", "chunk_end")
    return range_gaps(chunks, t.events("view"), ["user_id"], "s")

