"""Merge rules, catalog, calibration, intervals, windows, export: hand-computed fixtures."""

import glob
import json

import pytest
from helpers import rows, same, ts
from pyspark.sql import functions as F

from marketlake import schemas as S
from marketlake.operators import calibration as C
from marketlake.operators import catalog, history, intervals, merge, series
from marketlake.sinks.append import append_series, read_series
from marketlake.sinks.export import export_events
from marketlake.sources.legacy import import_legacy_tables
from marketlake.sources.tables import scan_landing, scan_tables

PM, KA = "polymarket", "kalshi"


def markets(spark, *items):
    base = dict.fromkeys(S.MARKETS.names)
    made = []
    for m in items:
        m = {**base, "backfilled": 0, "outage_affected": 0, **m}
        made.append(tuple(m[c] for c in S.MARKETS.names))
    return spark.createDataFrame(made, S.MARKETS)


# ------------------------------------------------------------------ merge

def test_coalesce_merge(spark):
    log = spark.createDataFrame([
        ("m", 1, 10, "old", "open", '{"a":1}'), ("m", 2, 20, None, "closed", "{}"), ("m", 3, 20, None, None, None), ("n", 4, 5, None, "x", "")],
        "id string, seq int, seen int, title string, status string, raw string")
    got = merge.coalesce_merge(log, ["id"], ["seq"], ["title", "status", "raw"], seen="seen", raw="raw")
    assert rows(got, "id", "title", "status", "raw", "first_seen_ts", "last_seen_ts") == [
        ("m", "old", "closed", '{"a":1}', 10, 20), ("n", None, "x", None, 5, 5)]


def test_insert_last_upsert_fields(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, seq int, v string")
    assert rows(merge.insert_if_absent(df, ["k"], ["seq"]), "k", "v") == [("a", "x"), ("b", "z")]
    stored = spark.createDataFrame([("b", 9, "old")], "k string, seq int, v string")
    new = merge.insert_if_absent(df, ["k"], ["seq"], stored)
    assert rows(new, "k", "v") == [("a", "x")]
    assert merge.insert_if_absent(df, ["k"], ["seq"], stored.unionByName(new)).count() == 0  # replay
    assert rows(merge.last_write_wins(df, ["k"], ["seq"]), "k", "v") == [("a", "y"), ("b", "z")]
    up = merge.partial_upsert(stored, merge.last_write_wins(df, ["k"], ["seq"]), ["k"], ["v"])
    assert rows(up) == [("a", 2, "y"), ("b", 9, "z")]
    patch = spark.createDataFrame([("b", 3, None)], "k string, seq int, v string")
    assert rows(merge.set_fields(stored, patch, ["k"], ["seq", "v"], greatest=["seq"])) == [("b", 9, "old")]


def test_upsert_sets_null(spark):
    """A NULL given for an updated column replaces the stored value."""
    old = spark.createDataFrame([("g", "w", "lck")], "k string, winner string, league string")
    new = spark.createDataFrame([("g", None, "lpl")], "k string, winner string, league string")
    assert rows(merge.partial_upsert(old, new, ["k"], ["winner"])) == [("g", None, "lck")]


def test_close_and_ongoing(spark):
    o = spark.createDataFrame([("p", "halt", 1, None, "n"), ("p", "halt", 5, 6, "n"), ("q", "halt", 2, None, "n")], S.OUTAGES)
    assert rows(intervals.ongoing_start(o, ["platform", "kind"])) == [("p", "halt", 1), ("q", "halt", 2)]
    closed = merge.close_open_intervals(o, spark.createDataFrame([("p", "halt", 9)], "platform string, kind string, end_ts long"), ["platform", "kind"])
    assert rows(closed, "platform", "start_ts", "end_ts") == [("p", 1, 9), ("p", 5, 6), ("q", 2, None)]
    assert [r[2] for r in intervals.recent_outages(o, [F.col("start_ts").desc()], 2).collect()] == [5, 2]


# ------------------------------------------------------------------ intervals

def test_overlap_boundaries_and_flags(spark):
    g = 1_000_000
    m = markets(spark, {"platform": KA, "market_id": "a", "game_start_ts": g}, {"platform": PM, "market_id": "b", "game_start_ts": g},
                {"platform": KA, "market_id": "c", "game_start_ts": None, "outage_affected": 1},
                {"platform": KA, "market_id": "d", "game_start_ts": g + 10**7})
    o = spark.createDataFrame([
        (KA, "halt", g + 28800, g + 30000, "touches end"), (KA, "halt", g + 28801, g + 30000, "after"),
        (KA, "halt", g - 9000, g - 2700, "touches start"), (KA, "halt", g - 9000, g - 2701, "before"),
        (KA, "halt", g - 10**6, None, "open"), (KA, "halt", g - 10**6, g + 10**6, "spans")], S.OUTAGES)
    got = intervals.interval_overlap(m, o, ["platform"], "game_start_ts", g + 5)
    assert rows(got.select("market_id", "note")) == [("a", "open"), ("a", "spans"), ("a", "touches end"), ("a", "touches start")]
    assert rows(intervals.flag_outages(m, o, g + 5), "market_id", "outage_affected") == [("a", 1), ("b", 0), ("c", 1), ("d", 0)]
    later = intervals.interval_overlap(m, o, ["platform"], "game_start_ts", g + 10**8)
    assert ("d", "open") in rows(later.select("market_id", "note"))


# ------------------------------------------------------------------ calibration

def test_bins_edges_and_rejects(spark):
    pairs = spark.createDataFrame([("x", 0.0, 0), ("x", 0.1, 1), ("x", 1.0, 1), ("x", None, 1), ("x", 1.2, 1), ("x", -0.1, 0)],
                                  "platform string, p double, y int")
    got = {(r["platform"], r["bin"]): r for r in C.reliability_bins(pairs, ["x", "y"], n_bins=10).collect()}
    assert len(got) == 20 and sum(r["n"] for r in got.values()) == 3
    assert got["x", 0]["n"] == 1 and got["x", 1]["mean_pred"] == 0.1 and got["x", 9]["n"] == 1
    assert got["y", 3]["n"] == 0 and got["y", 3]["mean_pred"] is None and got["x", 2]["lo"] == 0.2
    assert rows(C.rejected(pairs, ["platform"])) == [("x", 2)]
    assert rows(C.brier(pairs, ["x", "y"])) == [("x", 3, 0.27), ("y", 0, None)]
    assert C.clamp_bins(1) == 2 and C.clamp_bins(1000) == 100 and C.clamp_horizon(-10**9) == -7200


def raw(outs, prices):
    return json.dumps({"outcomes": json.dumps(outs), "outcomePrices": json.dumps(prices)})


def test_calibration_both_platforms(spark):
    g = 10_000
    closed = {"platform": PM, "status": "closed", "game_start_ts": g, "title": "LCK map 1"}
    m = markets(
        spark,
        {**closed, "market_id": "t1", "condition_id": "c1", "outcome": "A", "raw": raw(["A", "B"], ["1", "0"])},
        {**closed, "market_id": "t2", "condition_id": "c1", "outcome": "B", "raw": raw(["A", "B"], ["1", "0"])},
        {**closed, "market_id": "t3", "condition_id": "c2", "outcome": "A", "raw": raw(["A", "B"], ["1", "0"])},  # pair not priced
        {**closed, "market_id": "t5", "condition_id": "c3", "outcome": "A", "raw": raw(["A", "B"], ["0.5", "0.5"])},  # voided
        {**closed, "market_id": "t6", "condition_id": "c3", "outcome": "Z", "raw": raw(["A", "B"], ["0.5", "0.5"])},
        {**closed, "market_id": "t7", "outcome": "A", "raw": raw(["A", "B"], ["1", "0"])},  # no condition
        {**closed, "market_id": "t8", "outcome": "A", "raw": raw(["A", "B"], ["1", "0"])},
        {"platform": KA, "market_id": "k1", "status": "finalized", "result": "yes", "game_start_ts": g, "title": "x", "event_id": "LCK"},
        {"platform": KA, "market_id": "k2", "status": "settled", "result": "void", "game_start_ts": g, "title": "LCK"},
        {"platform": KA, "market_id": "k3", "status": "settled", "result": "no", "game_start_ts": g, "title": "LPL"})
    pp = spark.createDataFrame([(PM, t, 1, ts(g), 0.6) for t in ("t1", "t3", "t5", "t6", "t7", "t8")]
                               + [(PM, "t1", 1, ts(g + 1), 0.9), (PM, "t2", 10, ts(g), 0.9), (PM, "t2", 1, ts(g), 0.4)], S.PRICE_POINTS)
    quote = '{"yes_bid":{"close_dollars":"0.40"},"yes_ask":{"close_dollars":"0.50"}}'
    ca = spark.createDataFrame([(KA, k, 1, ts(g - 60), None, None, None, 0.3, 1.0, 1.0, quote) for k in ("k1", "k2")]
                               + [(KA, "k1", 1, ts(g - 30), None, None, None, None, 1.0, 1.0, "{}"),
                                  (KA, "k3", 1, ts(g - 60), None, None, None, 0.3, 1.0, 1.0, '{"yes_bid":{}}')], S.CANDLES)
    got = C.calibration_pairs(m, pp, ca)
    assert rows(got) == [(KA, "k1", 0.45, 1.0), (KA, "k3", 0.3, 0.0), (PM, "t1", 0.6, 1.0), (PM, "t2", 0.4, 0.0)]
    assert [r[1] for r in rows(C.calibration_pairs(m, pp, ca, text="lck"))] == ["k1", "t1", "t2"]
    assert C.calibration_pairs(m, pp, ca, text="l_k").count() == 0  # wildcards are literal
    whole = C.calibration(m, pp, ca, n_bins=10)
    assert whole.count() == 20 and {r[0] for r in whole.filter("platform = 'kalshi'").select("total_n").collect()} == {2}


# ------------------------------------------------------------------ catalog

def test_search_coverage_status(spark):
    m = markets(
        spark,
        {"platform": KA, "market_id": "a1", "event_id": "E1", "title": "T1 vs GEN", "outcome": "T1", "game_start_ts": 86400, "status": "active"},
        {"platform": KA, "market_id": "a2", "event_id": "E1", "title": "T1 vs GEN", "outcome": "GEN", "game_start_ts": 86400, "status": "settled", "outage_affected": 1, "backfilled": 1},
        {"platform": PM, "market_id": "b", "event_id": "E2", "title": "t1 100%", "game_start_ts": 2 * 86400, "status": "open"},
        {"platform": PM, "market_id": "c", "event_id": "E3", "title": "T1", "game_start_ts": None, "status": "closed"},
        {"platform": PM, "market_id": "d", "event_id": None, "title": "T1"})
    got = catalog.search_games(m, ["t1"])
    assert [tuple(r) for r in got.collect()] == [
        (PM, "E2", 1, 172800, "t1 100%", 0), (KA, "E1", 2, 86400, "T1 vs GEN", 1), (PM, "E3", 1, None, "T1", 0)]
    assert [r[1] for r in catalog.search_games(m, ["1970-01-02", "T1"]).collect()] == ["E2", "E1"]
    assert [r[1] for r in catalog.search_games(m, ["0%"]).collect()] == ["E2"]
    assert catalog.search_games(m, ["gen"]).collect()[0]["n_markets"] == 2
    with pytest.raises(ValueError):
        catalog.search_games(m, ["2024-13-01"])
    trades = spark.createDataFrame([(KA, "a1"), (KA, "a1"), (KA, "a2"), (PM, "zz")], "platform string, market_id string")
    none = trades.limit(0)
    assert rows(catalog.coverage(m, {"trades": trades, "books": none})) == [(KA, "E1", 3, 0), (PM, "E2", 0, 0), (PM, "E3", 0, 0)]
    plan = catalog.search_with_coverage(m, {"trades": trades}, ["gen"])._jdf.queryExecution().optimizedPlan().toString()
    count = plan.index("count(1) AS trades")
    assert "LeftSemi" in plan[count:]  # stored rows are reduced before they are counted
    found = catalog.search_with_coverage(m, {"trades": trades}, ["gen"]).collect()
    assert [(r["event_id"], r["n_markets"], r["trades"]) for r in found] == [("E1", 2, 3)]
    assert rows(catalog.event_markets(m.filter("event_id = 'E1'"), trades), "market_id", "n_trades", "event_start_ts") == [("a1", 2, 86400), ("a2", 1, 86400)]
    books = spark.createDataFrame([(PM, ts(7))], "platform string, ts timestamp")
    assert rows(catalog.platform_status(m, books, trades)) == [(KA, 2, 1, 1, 0, None, 3), (PM, 3, 1, 0, 1, 7000, 1)]
    tiers = catalog.watch_tiers(m, 86400 - 2700)
    assert rows(tiers, "market_id", "tier") == [("a1", "fast"), ("b", "slow")]
    assert [r[0] for r in rows(catalog.watch_tiers(m, 86400 - 2701), "tier")] == ["slow", "slow"]
    assert catalog.ilike_any(m, "event_id", "").count() == 4


def test_series(spark):
    p = spark.createDataFrame([("m", 1, 10, 0.5), ("m", 1, 1, None), ("m", 2, 10, 0.6)], "k string, t int, res int, p double")
    assert rows(series.finest_series(p, ["k"], "t", ["res"], "p")) == [("m", 2, 0.6)]
    assert rows(series.finest_series(p, ["k"], "t", ["res"], "p", skip_null=True)) == [("m", 1, 0.5), ("m", 2, 0.6)]
    lv = "array<struct<price:double,size:double>>"
    b = spark.createDataFrame([("m", 1, [(0.4, 1.0)], [(0.5, 1.0)]), ("m", 2, [], [(0.5, 1.0)])], f"k string, t int, bids {lv}, asks {lv}")
    assert rows(series.mid_series(b, ["k"], "t")) == [("m", 1, 0.45)]
    mk = lambda *r: spark.createDataFrame(list(r), "k string, ts int, price double")
    got = series.series_choice(mk(("a", 1, 0.1)), mk(("b", 1, 0.2)), mk(("a", 2, 0.3), ("c", 2, 0.4)), ["k"])
    assert rows(got, "k", "kind") == [("a", "price"), ("b", "mid"), ("c", "trades")]


# ------------------------------------------------------------------ history

def test_worklist_windows_chunks(spark):
    now, day = 10**9, 86400
    closed = {"platform": PM, "status": "closed", "condition_id": "c"}
    m = markets(
        spark,
        {**closed, "market_id": "t1", "open_ts": now - 40 * day, "close_ts": now - day, "game_start_ts": now - 2 * day, "raw": '{"volume":"5"}'},
        {**closed, "market_id": "t2", "open_ts": now - 5 * day, "close_ts": None, "raw": '{"volume":0}'},
        {"platform": KA, "status": "settled", "market_id": "k0", "open_ts": now - day, "close_ts": now, "raw": '{"volume_fp":"0.00"}'},
        {"platform": KA, "status": "finalized", "market_id": "k1", "open_ts": now - 30 * day, "close_ts": now + day, "raw": "{}"},
        {"platform": KA, "status": "open", "market_id": "k2"}, {"platform": KA, "status": "settled", "market_id": "k3", "backfilled": 1})
    work = history.backfill_worklist(m)
    assert [r["market_id"] for r in work.collect()] == ["t2", "k1", "k0", "t1"]
    assert [r["market_id"] for r in history.backfill_worklist(m, 1).collect()] == ["t2"]
    tasks = {r["task"]: r for r in history.worklist_tasks(work).collect()}
    assert tasks["c"]["n_markets"] == 2 and not tasks["c"]["skip"] and tasks["k0"]["skip"] and not tasks["k1"]["skip"]
    trades = spark.createDataFrame([(PM, "t1", ts(now - 3 * day))], "platform string, market_id string, ts timestamp")
    got = history.history_chunks(m, trades, now)
    parts = {}
    for r in got.collect():
        parts.setdefault((r["market_id"], r["resolution"]), []).append((r["chunk_start"], r["chunk_end"]))
    assert set(parts) == {("t1", 10), ("t1", 1), ("t2", 10), ("k1", 60), ("k1", 1)}
    # a day after its own last trade; the quiet token follows its condition
    assert min(parts["t1", 10])[0] == now - 23 * day and max(parts["t1", 10])[1] == now - 2 * day
    assert max(parts["t2", 10])[1] == now - 2 * day and min(parts["t2", 10])[0] == now - 5 * day
    assert parts["t1", 1] == [(now - 2 * day - 3600, now - 2 * day)]
    assert min(parts["k1", 60])[0] == now - 30 * day and parts["k1", 1][0][0] == now - 3 * day
    for chunk in parts.values():  # chunks tile their span
        chunk.sort()
        assert all(a[1] == b[0] for a, b in zip(chunk, chunk[1:]))


def test_chunks_empty_and_months(spark):
    df = spark.createDataFrame([("a", 5, 5, 10), ("b", 9, 1, 10), ("c", 0, 25, 10)], "k string, t0 long, t1 long, step long")
    assert rows(history.chunk_expand(df), "k", "chunk_start", "chunk_end") == sorted(
        [("c", 0, 10), ("c", 10, 20), ("c", 20, 25)], key=lambda r: (r[0], str(r[1])))
    one = spark.createDataFrame([(ts(0),)], "now timestamp")
    got = history.month_windows(one, "2023-01-01", F.lit("2023-01-31 05:00:00").cast("timestamp"), 1)
    assert [str(r[0]) for r in got.select("month_start").orderBy("month_start").collect()] == ["2023-01-01", "2023-02-01"]
    got = history.month_windows(one, "2023-01-01", F.lit("2023-01-31").cast("timestamp"), 1)
    assert got.count() == 1


def test_gaps(spark):
    c = spark.createDataFrame([("a", 0, 10), ("a", 10, 20), ("a", 20, 30)], "k string, chunk_start long, chunk_end long")
    s = spark.createDataFrame([("a", 10), ("a", 30)], "k string, t long")
    assert rows(history.range_gaps(c, s, ["k"], "t"), "chunk_start") == [(0,), (20,)]
    assert rows(history.coverage_gaps(c, s, ["k"], "t", 10), "chunk_start") == [(0,), (20,)]


# ------------------------------------------------------------------ storage

@pytest.fixture()
def store(spark):
    m = markets(spark, {"platform": KA, "market_id": "a", "event_id": "E/1", "game_start_ts": 5000}, {"platform": KA, "market_id": "b", "event_id": "E2"})
    book = spark.createDataFrame([(KA, "a", ts(1.5), None, [(0.4, 10.0)], [], "h")], S.BOOK_SNAPSHOTS)
    trades = spark.createDataFrame([(KA, "x1", "a", ts(2), 0.4, 1.0, "yes", "{}"), (KA, "x2", "b", ts(3), 0.5, 1.0, "no", "{}")], S.TRADES)
    return {"markets": m, "book_snapshots": book, "trades": trades,
            "price_points": spark.createDataFrame([], S.PRICE_POINTS), "candles": spark.createDataFrame([], S.CANDLES),
            "outages": spark.createDataFrame([(KA, "halt", 4000, None, "n")], S.OUTAGES)}


def test_export(spark, store, tmp_path):
    export_events(store, store["markets"].filter("market_id = 'a'"), str(tmp_path), 9000)
    files = sorted(p for p in glob.glob(f"{tmp_path}/*/dir=*/*.csv"))
    assert [p.split("/")[-3] for p in files] == ["book_snapshots", "markets", "outages", "trades"]
    assert all("dir=kalshi_E_1-" in p for p in files)
    text = {p.split("/")[-3]: open(p).read().splitlines() for p in files}
    assert text["trades"] == ["platform,market_id,trade_id,ts,price,size,side", "kalshi,a,x1,2,0.4,1.0,yes"]
    assert text["book_snapshots"][0] == "platform,market_id,ts_ms,source_ts_ms,bids,asks"
    assert text["book_snapshots"][1].startswith("kalshi,a,1500,")


def test_append_and_read(spark, tmp_path):
    path = f"{tmp_path}/s"
    df = spark.createDataFrame([(KA, "a", ts(0), 1.0), (KA, "a", ts(14 * 86400), 2.0), (PM, "b", ts(0), 3.0)], "platform string, market_id string, ts timestamp, p double")
    append_series(df, path)
    append_series(df.limit(1), path)
    assert read_series(spark, path).count() == 4
    late = read_series(spark, path, first="1970-01-10")
    assert rows(late, "p") == [(2.0,)]
    assert "week" in late._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:120]


def test_scan_tables(spark, store, tmp_path):
    for name, df in store.items():
        df.write.parquet(f"{tmp_path}/{name}")
    for name in ("oe_games", "oe_picks", "oe_bans", "draft_deltas", "draft_model"):
        spark.createDataFrame([], S.TABLES[name]).write.parquet(f"{tmp_path}/{name}")
    tables = scan_tables(spark, str(tmp_path))
    assert same(tables["trades"], store["trades"]) and tables["markets"].schema == S.MARKETS
    plan = tables["trades"].filter("market_id = 'a'").select("price")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(market_id,a)" in plan and "ReadSchema: struct<market_id:string,price:double>" in plan
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "x.json").write_text('{"a":1}\n{"a":2}\n')
    assert scan_landing(spark, f"{tmp_path}/l").count() == 2


def test_legacy_import_is_idempotent(spark):
    dump = {
        "markets": spark.createDataFrame([(KA, "a", "E", None, None, "t", "o", 5, None, None, "open", None, 7, 1, 0, 3, 9, "{}")],
                                         S.MARKETS),
        "book_snapshots": spark.createDataFrame([(KA, "a", 1500, 0, "[[0.4,10]]", "[]", "h")], "platform string, market_id string, ts_ms long, source_ts_ms long, bids string, asks string, hash string"),
        "trades": spark.createDataFrame([(KA, "x", "a", 2, 0.4, 1.0, "yes", None), (KA, "x", "a", 2, 0.4, 1.0, "yes", None)], "platform string, trade_id string, market_id string, ts long, price double, size double, side string, raw string"),
        "price_points": spark.createDataFrame([(KA, "a", 1, 2, 0.3)], "platform string, market_id string, fidelity int, ts long, price double"),
        "candles": spark.createDataFrame([(KA, "a", 1, 60, 0.1, 0.2, 0.1, 0.2, 1.0, 1.0, None)], "platform string, market_id string, period_min int, ts long, open double, high double, low double, close double, volume double, open_interest double, raw string"),
        "outages": spark.createDataFrame([(KA, "halt", 1, None, "n"), (KA, "halt", 5, 8, "n")], S.OUTAGES)}
    once = import_legacy_tables(dump)
    twice = import_legacy_tables(dump, once)
    for name, df in once.items():
        assert df.count() > 0 and rows(df) == rows(twice[name]), name
    assert rows(once["trades"], "trade_id", "raw") == [("x", "{}")]
    m = once["markets"].collect()[0]
    assert (m["first_seen_ts"], m["last_seen_ts"], m["raw"], m["backfilled"], m["last_trade_ts"]) == (9, 9, None, 1, 7)
    assert rows(once["outages"], "start_ts", "end_ts") == [(1, None), (5, 8)]
    assert once["book_snapshots"].collect()[0]["bids"][0]["size"] == 10.0


def test_legacy_import_drops_stored_rows_first(spark):
    book = "platform string, market_id string, ts_ms long, source_ts_ms long, bids string, asks string"
    rest = {"markets": S.MARKETS, "trades": "platform string, trade_id string, market_id string, ts long, price double, size double, side string, raw string",
            "price_points": "platform string, market_id string, fidelity int, ts long, price double",
            "candles": "platform string, market_id string, period_min int, ts long, open double, high double, low double, close double, volume double, open_interest double, raw string",
            "outages": S.OUTAGES}
    dump = {name: spark.createDataFrame([], of) for name, of in rest.items()}
    dump["book_snapshots"] = spark.createDataFrame([(KA, "a", 1500, 0, "[[0.4,10]]", "[]"), (KA, "a", 1500, 0, "[[0.4,10]]", "[]")], book)
    once = import_legacy_tables(dump)
    dump["book_snapshots"] = dump["book_snapshots"].union(spark.createDataFrame([(KA, "a", 2500, 0, "[]", "[[0.5,1]]")] * 2, book))
    new = import_legacy_tables(dump, once, whole=False)["book_snapshots"]
    assert [(r["bids"], r["asks"][0]["price"]) for r in new.collect()] == [([], 0.5)]
    assert import_legacy_tables(dump, once)["book_snapshots"].count() == 2
    # Texts are parsed once rows are dealt out by key (one sort), and for rows that are not stored only.
    plan = once["book_snapshots"]._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("from_json") < plan.index("Exchange")
    whole = new._jdf.queryExecution().optimizedPlan().toString()
    assert whole.index("from_json") < whole.index("LeftAnti")
