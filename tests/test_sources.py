"""Raw documents and match CSV."""

import json

from helpers import rows, ts
from pyspark.sql import functions as F

from marketlake.functions.texts import norm_team, patch_key
from marketlake.functions.times import match_date, parse_ts, ticker_start
from marketlake.sources import matches
from marketlake.sources import ticker_exchange as K
from marketlake.sources import token_exchange as P


def docs(spark, *items):
    return spark.createDataFrame([(None if d is None else json.dumps(d) if not isinstance(d, str) else d,) for d in items], "value string")


def values(spark, fn, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x"))).collect()]


def test_parse_ts(spark):
    base = 1785585600  # 2026-08-01 12:00
    assert values(spark, parse_ts, "2026-08-01T12:00:00Z", "2026-08-01 12:00:00+00", "2026-08-01T12:00:00+0000", "2026-08-01T17:30:00+05:30",
                  "2026-08-01T12:00:00.987", "2026-08-01 12:00:00 trailing", " 2026-08-01T11:00:00-01 ") == [base] * 7
    assert values(spark, parse_ts, "2026-08-01", "2026-13-01T00:00:00Z", "x", "", None, "x2026-08-01T12:00:00Z") == [None] * 6
    assert values(spark, parse_ts, str(base), str(base * 1000 + 999), "0") == [base, base, 0]


def test_ticker_start(spark):
    assert values(spark, ticker_start, "KX-26AUG090300LNGIG", "KX-26MAR080230A", "KX-26NOV010130A", "KX-26FEB300100A", "KX-26aug090300A", None) == [
        1786258800, 1772955000, 1793511000, None, None, None]


def test_names_and_patches(spark):
    assert values(spark, norm_team, "T1 Esports", "Team Gaming", "G2-Esports!", None, "Gen.G") == ["t1", "team gaming", "g2", "", "gen g"]
    assert values(spark, patch_key, "16.9", "16.10", "x.2") == [[16, 9], [16, 10], [0, 2]]
    assert values(spark, match_date, "2026-08-01 12:00:00", "2026-08-01", "2026-02-30 00:00:00") == [1785585600, None, None]


def test_token_markets(spark):
    m = {"clobTokenIds": '["1","2"]', "outcomes": ["A"], "gameStartTime": "2026-08-01 12:00:00+00", "conditionId": "c", "question": "q",
         "startDate": "x", "endDate": "2026-08-01T12:00:00Z", "closed": True, "umaResolutionStatus": "resolved", "outcomePrices": '["1","0"]',
         "events": [{"id": 1}]}
    ev = {"slug": "s", "startTime": "2026-08-01T13:00:00Z", "eventDate": "2026-08-01T14:00:00Z", "markets": [
        m, {**m, "clobTokenIds": ["3"], "gameStartTime": "0", "enableOrderBook": True, "closed": False}, {**m, "enableOrderBook": False},
        {**m, "enableOrderBook": None}, {**m, "clobTokenIds": "[]"}, {**m, "clobTokenIds": "bad json"}, {"question": "no tokens"}]}
    got = P.normalize_token_markets(docs(spark, ev, {"slug": "none"}, "broken"))
    assert rows(got, "market_id", "outcome", "game_start_ts", "status") == [
        ("1", "A", 1785585600, "closed"), ("2", "1", 1785585600, "closed"), ("3", "A", 1785589200, "open")]
    r = got.filter("market_id = '1'").collect()[0]
    assert (r["event_id"], r["condition_id"], r["title"], r["open_ts"], r["close_ts"], r["result"]) == ("s", "c", "q", None, 1785585600, "resolved")
    assert "events" not in json.loads(r["raw"]) and json.loads(r["raw"])["outcomePrices"] == '["1","0"]'


def test_books(spark):
    two = docs(spark, {"asset_id": "9", "timestamp": "1500", "bids": [{"price": "0.1", "size": "5"}, {"price": "0.3", "size": "6"}],
                       "asks": [{"price": "0.9", "size": "1"}, {"price": "0.5", "size": "2"}]}, {"asset_id": 8}).withColumn("capture_ts", F.lit(ts(9)))
    got = {r["market_id"]: r for r in P.normalize_books_twosided(two).collect()}
    assert [tuple(x) for x in got["9"]["bids"]] == [(0.3, 6.0), (0.1, 5.0)] and [x[0] for x in got["9"]["asks"]] == [0.5, 0.9]
    assert got["9"]["source_ts"] == ts(1.5) and got["8"]["bids"] == [] and got["8"]["source_ts"] is None
    yn = docs(spark, {"orderbook_fp": {"yes_dollars": [["0.10", "5"], ["0.24", "7"]], "no_dollars": [["0.70", "3"]]}},
              {"orderbook": {"yes": [[24, 100]], "no": [[1, 5], [70, 9]]}}, {"orderbook_fp": {"yes_dollars": [], "yes": [[5, 1]]}}, {})
    yn = yn.withColumn("capture_ts", F.lit(ts(9))).withColumn("market_id", F.monotonically_increasing_id().cast("string"))
    books = [r for r in K.normalize_books_yes_no(yn).orderBy(F.col("market_id").cast("long")).collect()]
    assert [[tuple(x) for x in b["bids"]] for b in books] == [[(0.24, 7.0), (0.1, 5.0)], [(0.24, 100.0)], [(0.05, 1.0)], []]
    assert [[tuple(x) for x in b["asks"]] for b in books] == [[(0.3, 3.0)], [(0.3, 9.0), (0.99, 5.0)], [], []]
    assert books[0]["hash"] != books[1]["hash"]


def test_trades(spark):
    a = P.normalize_token_trades(docs(spark, {"timestamp": 5, "transactionHash": None, "proxyWallet": "w", "asset": "1", "price": 0.5, "size": 2, "side": "BUY"}))
    r = a.collect()[0]
    import hashlib
    assert r["trade_id"] == hashlib.sha1(b"|w|1|5|0.5|2|BUY").hexdigest()
    assert (r["market_id"], r["price"], r["size"], r["side"], r["ts"]) == ("1", 0.5, 2.0, "buy", ts(5))
    b = docs(spark, {"trade_id": "x", "created_time": "1970-01-01T00:00:05Z", "yes_price_dollars": "0.2400", "count_fp": "3.00", "taker_side": "yes"},
             {"trade_id": "y", "created_time": None, "yes_price": 24, "count": 7}).withColumn("market_id", F.lit("m"))
    assert rows(K.normalize_ticker_trades(b), "trade_id", "price", "size", "side", "ts") == [("x", 0.24, 3.0, "yes", ts(5)), ("y", 0.24, 7.0, "", ts(0))]


def test_candles(spark):
    c = docs(spark, {"end_period_ts": 60, "price": {"open_dollars": "0.1", "open": 99, "high_dollars": None, "high": 99, "low": 7},
                     "yes_bid": {"high": 20, "close_dollars": "0.33"}, "volume_fp": "12.5", "volume": 1, "open_interest": 4},
             {"end_period_ts": 120}).withColumn("market_id", F.lit("m")).withColumn("period_min", F.lit(1))
    got = [tuple(r) for r in K.normalize_candles(c).orderBy("ts").select("open", "high", "low", "close", "volume", "open_interest").collect()]
    assert got == [(0.1, 0.2, 0.07, 0.33, 12.5, 4.0), (None, None, None, None, 0.0, 0.0)]


def test_status_and_maintenance(spark):
    on = {"exchange_active": True, "trading_active": True}
    polls = docs(spark, on, {**on, "exchange_index_statuses": [{"exchange_index": 0, "trading_active": True}]},
                 {**on, "exchange_index_statuses": [{"exchange_index": 1}]}, {"exchange_active": True}, None)
    polls = polls.withColumn("ts", F.monotonically_increasing_id())
    assert [r["active"] for r in K.normalize_exchange_status(polls).orderBy("ts").collect()] == [True, False, True, False, None]
    s = docs(spark, {"schedule": {"maintenance_windows": [{"start_datetime": "1970-01-01T00:01:00Z", "end_time": "1970-01-01T00:02:00Z"},
                                                          {"start_time": "1970-01-01T00:03:00Z"}, {"end_time": "1970-01-01T00:03:00Z"}]}}, {"schedule": None})
    assert rows(K.normalize_maintenance(s), "kind", "start_ts", "end_ts") == sorted(
        [("maintenance", 60, 120), ("maintenance", 180, None)], key=lambda r: str(r[1]))


def test_match_csv(spark, tmp_path):
    head = "gameid,league,date,game,patch,position,side,result,teamname,champion," + ",".join(f"pick{i}" for i in range(1, 6)) + "," + ",".join(f"ban{i}" for i in range(1, 6))
    def team(g, side, result, name, date="2026-08-01 12:00:00"):
        return f"{g},LCK,{date},1,16.10,team,{side},{result},{name},, Ashe ,Jinx,,,,Zed,Zed,Ahri,,"
    def player(g, side, name, champ, pos):
        return f"{g},LCK,2026-08-01 12:00:00,1,16.10,{pos},{side},0,{name},{champ},,,,,,,,,,"
    (tmp_path / "a.csv").write_text("\n".join([
        head, player("g1", "Blue", "T1", "Ashe", "bot"), player("g1", "Blue", "T1", "Ornn", "top"), team("g1", "Blue", "1", "T1"),
        team("g1", "Red", "0", "GEN"), team("", "Blue", "1", "skip"), team("g2", "blue", "0", "T1", "bad date")]) + "\n")
    (tmp_path / "b.csv").write_text("\n".join([head, team("g1", "Blue", "0", "T9", "2026-08-02 12:00:00"), team("g1", "Red", "1", "GEN")]) + "\n")
    t = matches.load_match_csv(spark, [f"{tmp_path}/a.csv"])
    assert rows(t["oe_games"]) == [("g1", "LCK", 1785585600, 1, "16.10", "T1", "GEN", "T1"), ("g2", "LCK", None, 1, "16.10", "T1", None, None)]
    assert rows(t["oe_picks"].filter("game_id = 'g1' AND team = 'T1'"), "champion", "position", "pick_order") == [
        ("Ashe", "bot", 1), ("Jinx", None, 2), ("Ornn", "top", None)]
    assert rows(t["oe_bans"].filter("game_id = 'g1' AND team = 'T1'"), "champion", "ban_order") == [("Ahri", 3), ("Zed", 1)]
    both = matches.load_match_csv(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/b.csv"])
    g1 = both["oe_games"].filter("game_id = 'g1'").collect()[0]
    assert (g1["blue_team"], g1["winner"], g1["date_utc"]) == ("T1", "GEN", 1785585600 + 86400)
    later = matches.load_match_csv(spark, [f"{tmp_path}/b.csv"])["oe_games"]
    again = matches.reload_games(t["oe_games"], later).filter("game_id = 'g1'").collect()[0]
    assert (again["blue_team"], again["winner"]) == ("T1", "GEN")
