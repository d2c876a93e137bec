"""Rankings of draft deltas by team, champion and champion pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import sql_round
from .catalog import ilike_any

GAME = ["oe_game_id", "team"]


def per_game(deltas: DataFrame, platform: str = "", leagues: str = "") -> DataFrame:
    """One observation per (game, team), averaged over platforms. A NULL league never passes."""
    if platform:
        deltas = deltas.filter(F.col("platform") == platform)
    return (ilike_any(deltas, "league", leagues).groupBy(*GAME)
            .agg(F.min("league").alias("league"), F.avg("delta").alias("delta"),
                 F.avg("pre_p").alias("pre_p"), F.avg("post_p").alias("post_p"),
                 F.max("won").alias("won")))


def _enough(df: DataFrame, min_n: int) -> DataFrame:
    return df.filter(F.col("n") >= max(1, min_n))


def _effect() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), sql_round(F.avg("delta"), 4).alias("avg_delta"),
            sql_round(F.avg(F.col("won").cast("double")), 3).alias("win_rate")]


def team_ranking(games: DataFrame, min_n: int = 8) -> DataFrame:
    n, delta, wins = _effect()
    ranked = games.groupBy("team").agg(
        n, delta, sql_round(F.avg("pre_p"), 3).alias("avg_pre"),
        sql_round(F.avg("post_p"), 3).alias("avg_post"), wins,
        sql_round(F.avg(F.col("won") - F.col("post_p")), 4).alias("post_edge"))
    return _enough(ranked, min_n).orderBy(F.col("avg_delta").desc(), "team")


def champion_ranking(games: DataFrame, picks: DataFrame, min_n: int = 10) -> DataFrame:
    """``picks`` has one row per (game, team, champion)."""
    own = picks.select(F.col("game_id").alias("oe_game_id"), "team", "champion")
    ranked = games.join(own, GAME).groupBy("champion").agg(*_effect())
    return _enough(ranked, min_n).orderBy(F.col("avg_delta").desc(), "champion")


def ordered_pairs(items: Column) -> Column:
    """All (c1, c2) with c1 before c2 of a sorted array without repeats."""
    return F.flatten(F.transform(items, lambda a, i: F.transform(
        F.slice(items, i + 2, F.size(items)), lambda b: F.struct(a.alias("c1"), b.alias("c2")))))


def pick_sets(picks: DataFrame) -> DataFrame:
    """Champions per (game, team), sorted; the set is bounded by the champion list."""
    return (picks.groupBy(F.col("game_id").alias("oe_game_id"), "team")
            .agg(F.array_sort(F.collect_set("champion")).alias("champions")))


def pair_ranking(games: DataFrame, picks: DataFrame, min_n: int = 6) -> DataFrame:
    """Champion pairs of one team. Pairs are formed inside the (small) set of a team's picks."""
    pairs = (games.select(*GAME, "delta", "won").join(pick_sets(picks), GAME)
             .select("delta", "won", F.explode(ordered_pairs(F.col("champions"))).alias("pair")))
    ranked = pairs.groupBy(F.col("pair.c1").alias("c1"), F.col("pair.c2").alias("c2")).agg(*_effect())
    return _enough(ranked, min_n).orderBy(F.col("avg_delta").desc(), "c1", "c2")


def top_bottom_k(ranking: DataFrame, order: str, key: list[str], k: int) -> DataFrame:
    """First and last k rows of a ranking (all rows when there are at most 2k)."""
    top = ranking.orderBy(F.col(order).desc(), *key).limit(k)
    bottom = (ranking.orderBy(F.col(order).asc(), *[F.col(c).desc() for c in key]).limit(k)
              .join(F.broadcast(top.select(*key)), key, "left_anti"))  # at most k rows
    return (top.withColumn("part", F.lit("top"))
            .unionByName(bottom.select(*ranking.columns).withColumn("part", F.lit("bottom"))))


def top_by(ranking: DataFrame, column: str, key: list[str], k: int = 40, descending: bool = True) -> DataFrame:
    """The k rows that lead when sorted by any column."""
    c = F.col(column)
    return ranking.orderBy(c.desc() if descending else c.asc(), *key).limit(k)
