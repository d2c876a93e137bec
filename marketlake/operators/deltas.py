"""How odds move over champion select: candidates, matching, and odds before and after."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import (BINARY_RESULTS, GAME_SPACING, MAP_WINNER_SERIES, MATCH_WINDOW, POST_DRAFT,
                         PRE_DRAFT, TICKER_PLATFORM, TICKER_SETTLED_STATUSES, TOKEN_PLATFORM,
                         TOKEN_TERMINAL_STATUSES, YES_NO_OUTCOMES)
from ..functions.numbers import quote_midpoint, sql_round
from ..functions.texts import norm_team
from ..session import materialize
from .asof import asof_backward, nearest
from .ordered import ROWS_PER_SEGMENT

KEY = ["platform", "market_id"]


def map_winner_candidates(markets: DataFrame) -> DataFrame:
    """Per-map winner markets: platform, market, team, series start and map number."""
    start = F.col("game_start_ts").isNotNull()

    def pick(rows, pattern):
        number = F.regexp_extract("title", pattern, 1).try_cast("int")
        return (rows.withColumn("map_n", number).filter(F.col("map_n").isNotNull())
                .select(*KEY, F.col("outcome").alias("team"),
                        F.col("game_start_ts").alias("series_start"), "map_n"))

    tickers = markets.filter(
        (F.col("platform") == TICKER_PLATFORM) & (F.col("series") == MAP_WINNER_SERIES)
        & F.col("status").isin(*TICKER_SETTLED_STATUSES) & F.col("result").isin(*BINARY_RESULTS)
        & start & F.col("outcome").isNotNull())
    tokens = markets.filter(
        (F.col("platform") == TOKEN_PLATFORM) & F.col("status").isin(*TOKEN_TERMINAL_STATUSES)
        & start & ~F.col("outcome").isin(*YES_NO_OUTCOMES))
    return pick(tickers, r"(?i)map (\d+)").unionByName(pick(tokens, r"(?i)Game (\d+) Winner"))


def game_sides(games: DataFrame) -> DataFrame:
    """Finished, dated games once per team, with the team's comparable name."""
    done = (games.filter(F.col("winner").isNotNull() & F.col("date_utc").isNotNull())
            .withColumn("blue_key", norm_team(F.col("blue_team")))
            .withColumn("red_key", norm_team(F.col("red_team"))))
    sides = done.withColumn("team_key", F.explode(F.array("blue_key", "red_key")))
    is_blue = F.col("blue_key") == F.col("team_key")
    team = F.when(is_blue, F.col("blue_team")).otherwise(F.col("red_team"))
    opponent = (F.when(is_blue | F.col("blue_team").eqNullSafe(F.col("red_team")), F.col("red_team"))
                .otherwise(F.col("blue_team")))
    return sides.select("team_key", F.col("game_num").alias("map_n"), "date_utc", "game_id",
                        team.alias("oe_team"), opponent.alias("opponent"), "league", "winner")


def match_games(candidates: DataFrame, games: DataFrame, window: int = MATCH_WINDOW,
                rows_per_segment: int | None = ROWS_PER_SEGMENT) -> DataFrame:
    """Each candidate with the game of its team and map number nearest to its expected start."""
    probes = (candidates.withColumn("team_key", norm_team(F.col("team")))
              .withColumn("expected", F.col("series_start") + (F.col("map_n") - 1) * GAME_SPACING))
    hits = nearest(probes, game_sides(games), ["team_key", "map_n"], "expected", "date_utc",
                   ["game_id", "date_utc", "oe_team", "opponent", "league", "winner"], tie="game_id",
                   tolerance=window, rows_per_segment=rows_per_segment)
    return hits.select(*KEY, F.col("game_id").alias("oe_game_id"), F.col("oe_team").alias("team"),
                       "opponent", "league", F.col("date_utc").alias("game_start"),
                       F.col("map_n").alias("game_num"), "winner", "distance")


def price_ticks(price_points: DataFrame, candles: DataFrame) -> DataFrame:
    """One tick table of both platforms: price points, and quote midpoints of candles."""
    tokens = (price_points.filter(F.col("platform") == TOKEN_PLATFORM)
              .select(*KEY, "ts", F.col("fidelity").alias("resolution"), F.col("price").alias("p")))
    tickers = (candles.filter((F.col("platform") == TICKER_PLATFORM) & F.col("close").isNotNull())
               .select(*KEY, "ts", F.col("period_min").alias("resolution"),
                       quote_midpoint(F.col("raw"), F.col("close")).alias("p")))
    return tokens.unionByName(tickers)


def odds_around(matched: DataFrame, ticks: DataFrame, start: str = "game_start", *,
                before: int = PRE_DRAFT, after: int = POST_DRAFT, extra: list[str] = (),
                rows_per_segment: int | None = ROWS_PER_SEGMENT) -> DataFrame:
    """Odds before and after the draft per market, both from one pass over the ticks.

    The later price must come from the draft itself, not from before it. ``extra``
    columns tell several starts of one market apart.
    """
    g = F.col(start)
    times = F.explode(F.array(
        F.struct(F.lit("pre").alias("kind"), (g - before).alias("at"), F.lit(None).cast("bigint").alias("floor")),
        F.struct(F.lit("post").alias("kind"), (g + after).alias("at"), (g - before).alias("floor"))))
    probes = (matched.select(*KEY, *extra, times.alias("x"))
              .select(*KEY, *extra, "x.kind", F.timestamp_seconds("x.at").alias("probe_ts"),
                      F.timestamp_seconds("x.floor").alias("floor_ts")))
    oldest = F.coalesce(F.col("floor_ts"), F.timestamp_seconds(F.lit(-(2**40))))
    seen = asof_backward(probes, ticks, KEY, "probe_ts", "ts", ["p"], tie="resolution",
                         earliest=oldest, rows_per_segment=rows_per_segment)
    return seen.groupBy(*KEY, *extra).agg(
        F.max(F.when(F.col("kind") == "pre", F.col("p"))).alias("pre_p"),
        F.max(F.when(F.col("kind") == "post", F.col("p"))).alias("post_p"))


def odds_of_starts(matched: DataFrame, ticks: DataFrame, start: str = "game_start", *,
                   before: int = PRE_DRAFT, after: int = POST_DRAFT) -> DataFrame:
    """``odds_around`` for markets that start once, as a catalog has them: the ticks are read once.

    Every tick meets the starts of its market, so a market with many starts belongs to ``odds_around``.
    """
    g = F.col(start)
    floor = F.timestamp_seconds(g - before)
    seen = (ticks.select(*KEY, "ts", "resolution", "p").join(matched.select(*KEY, start).distinct(), KEY)
            .filter(F.col("ts") <= F.timestamp_seconds(g + after)))
    # Of one instant the finest resolution, as in the as-of join.
    last = F.struct("ts", (-F.col("resolution")).cast("double").alias("rank"), F.xxhash64(F.struct("ts", "p")).alias("salt"))
    picked = seen.groupBy(*KEY, start).agg(
        F.max_by(F.struct("p"), F.when(F.col("ts") <= floor, last)).alias("pre"), F.max_by(F.struct("ts", "p"), last).alias("post"))
    return picked.groupBy(*KEY).agg(
        F.max("pre.p").alias("pre_p"), F.max(F.when(F.col("post.ts") >= floor, F.col("post.p"))).alias("post_p"))


def build_deltas(markets: DataFrame, games: DataFrame, price_points: DataFrame, candles: DataFrame,
                 rows_per_segment: int | None = ROWS_PER_SEGMENT) -> DataFrame:
    """Draft deltas of every market that can be matched and is priced on both sides."""
    matched = match_games(map_winner_candidates(markets), games, rows_per_segment=rows_per_segment)
    matched = materialize(matched, "matched")  # a catalog-sized table, read twice below
    odds = odds_of_starts(matched, price_ticks(price_points, candles))
    return (matched.join(odds.filter(F.col("pre_p").isNotNull() & F.col("post_p").isNotNull()), KEY)
            .select(*KEY, "oe_game_id", "team", "opponent", "league", "game_start", "game_num",
                    "pre_p", "post_p", sql_round(F.col("post_p") - F.col("pre_p"), 4).alias("delta"),
                    F.when(F.col("winner") == F.col("team"), 1).otherwise(0).alias("won")))
