"""Column types of the stored tables and of the raw landing records."""

from __future__ import annotations

from pyspark.sql import types as T


S, D, L, I, B = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.BooleanType()
SHORT, TS = T.ShortType(), T.TimestampType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


#: One side of a book, best level first.
LEVELS = T.ArrayType(_schema(price=D, size=D))

MARKETS = _schema(
    platform=S, market_id=S, event_id=S, series=S, condition_id=S, title=S, outcome=S,
    game_start_ts=L, open_ts=L, close_ts=L, status=S, result=S, last_trade_ts=L,
    backfilled=SHORT, outage_affected=SHORT, first_seen_ts=L, last_seen_ts=L, raw=S)

BOOK_SNAPSHOTS = _schema(
    platform=S, market_id=S, ts=TS, source_ts=TS, bids=LEVELS, asks=LEVELS, hash=S)

TRADES = _schema(
    platform=S, trade_id=S, market_id=S, ts=TS, price=D, size=D, side=S, raw=S)

PRICE_POINTS = _schema(
    platform=S, market_id=S, fidelity=I, ts=TS, price=D)

CANDLES = _schema(
    platform=S, market_id=S, period_min=I, ts=TS, open=D, high=D, low=D, close=D, volume=D,
    open_interest=D, raw=S)

OUTAGES = _schema(
    platform=S, kind=S, start_ts=L, end_ts=L, note=S)

STATUS_POLLS = _schema(
    platform=S, ts=L, active=B)

MATCH_GAMES = _schema(
    game_id=S, league=S, date_utc=L, game_num=I, patch=S, blue_team=S, red_team=S, winner=S)

MATCH_PICKS = _schema(
    game_id=S, team=S, champion=S, position=S, pick_order=I)

MATCH_BANS = _schema(
    game_id=S, team=S, champion=S, ban_order=I)

DRAFT_DELTAS = _schema(
    platform=S, market_id=S, oe_game_id=S, team=S, opponent=S, league=S, game_start=L,
    game_num=I, pre_p=D, post_p=D, delta=D, won=I)

DRAFT_MODEL = _schema(
    feature=S, coef=D, n=L)

DRAFT_ACTIONS = _schema(
    draft_id=L, step=I, side=S, action=S, champion=S, role=S, pre_blue=D, patch=S)

#: One raw JSON document per row.
LANDING = _schema(
    value=S)

#: Book documents carry the capture time (and for tickers the market) beside them.
BOOK_LANDING = _schema(
    market_id=S, capture_ts=TS, value=S)

_PICKS = {f"pick{i}": S for i in range(1, 6)}
_BANS = {f"ban{i}": S for i in range(1, 6)}
MATCH_CSV = _schema(
    gameid=S, league=S, date=S, game=S, patch=S, position=S, side=S, result=S, teamname=S,
    champion=S, **_PICKS, **_BANS)

TABLES = {
    "markets": MARKETS, "book_snapshots": BOOK_SNAPSHOTS, "trades": TRADES,
    "price_points": PRICE_POINTS, "candles": CANDLES, "outages": OUTAGES,
    "oe_games": MATCH_GAMES, "oe_picks": MATCH_PICKS, "oe_bans": MATCH_BANS,
    "draft_deltas": DRAFT_DELTAS, "draft_model": DRAFT_MODEL,
}

#: Keys that identify one row of each stored table.
KEYS = {
    "markets": ["platform", "market_id"],
    "book_snapshots": ["platform", "market_id", "ts"],
    "trades": ["platform", "trade_id", "ts"],
    "price_points": ["platform", "market_id", "fidelity", "ts"],
    "candles": ["platform", "market_id", "period_min", "ts"],
    "outages": ["platform", "kind", "start_ts"],
    "oe_games": ["game_id"],
    "oe_picks": ["game_id", "team", "champion"],
    "oe_bans": ["game_id", "team", "champion"],
    "draft_deltas": ["platform", "market_id"],
    "draft_model": ["feature"],
}
