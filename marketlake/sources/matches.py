"""Match statistics: one wide CSV of team and player rows to games, picks and bans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import to_double
from ..functions.times import match_date
from ..operators.merge import partial_upsert
from ..schemas import MATCH_CSV

SLOTS = range(1, 6)


def read_match_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """CSV rows as text with their place: ``file`` and ``row`` (order inside the file)."""
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(paths)
    cols = [F.col(f.name) if f.name in raw.columns else F.lit(None).cast("string").alias(f.name)
            for f in MATCH_CSV.fields]
    # Rows of one block arrive in order, so the id orders them inside the block.
    return raw.select(*cols, F.col("_metadata.file_path").alias("file"),
                      F.struct(F.col("_metadata.file_block_start").alias("block"),
                               F.monotonically_increasing_id().alias("i")).alias("row"))


def _rows(csv: DataFrame) -> DataFrame:
    return csv.filter(F.col("gameid") != "")


def match_games(csv: DataFrame) -> DataFrame:
    """One row per game. The first row of a file names league, date, number and patch;
    its team rows name the sides and the winner. Across files only winner and date move on."""
    team = F.col("position") == "team"
    blue = F.lower("side") == "blue"

    def last_team(cond):
        return F.max_by("teamname", F.when(team & cond, F.col("row")))

    number = F.coalesce(to_double(F.col("game")), F.lit(0.0)).cast("int")
    per_file = (_rows(csv).groupBy("gameid", "file")
                .agg(F.min_by(F.struct("league", match_date(F.col("date")).alias("date_utc"),
                                       number.alias("game_num"), "patch"), "row").alias("head"),
                     last_team(blue).alias("blue_team"), last_team(~blue).alias("red_team"),
                     last_team(F.col("result") == "1").alias("winner")))
    first = F.min_by(F.struct("head.league", "head.game_num", "head.patch", "blue_team", "red_team"), "file")
    return (per_file.groupBy(F.col("gameid").alias("game_id"))
            .agg(first.alias("f"), F.max_by("head.date_utc", "file").alias("date_utc"),
                 F.max_by("winner", "file").alias("winner"))
            .select("game_id", "f.league", "date_utc", "f.game_num", "f.patch",
                    "f.blue_team", "f.red_team", "winner"))


def _slots(csv: DataFrame, name: str) -> DataFrame:
    """The five numbered columns of team rows as rows, blanks dropped."""
    wide = (_rows(csv).filter(F.col("position") == "team")
            .select("gameid", "teamname", "file", "row",
                    *[F.col(f"{name}{i}").alias(str(i)) for i in SLOTS]))
    return (wide.unpivot(["gameid", "teamname", "file", "row"], [str(i) for i in SLOTS], "slot", "champion")
            .withColumn("champion", F.trim("champion")).filter(F.col("champion") != "")
            .withColumn("slot", F.col("slot").cast("int")))


def match_picks(csv: DataFrame) -> DataFrame:
    """Picks per (game, team, champion): role from player rows, order from team rows."""
    ordered = _slots(csv, "pick").select(
        "gameid", "teamname", "champion", F.lit(None).cast("string").alias("position"),
        F.col("slot").alias("pick_order"), F.struct("file", "row", "slot").alias("seq"))
    players = (_rows(csv).filter((F.col("position").isNull() | (F.col("position") != "team"))
                                 & (F.col("champion") != ""))
               .select("gameid", "teamname", "champion", "position",
                       F.lit(None).cast("int").alias("pick_order"),
                       F.struct("file", "row", F.lit(0).alias("slot")).alias("seq")))

    def last_known(c):
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)

    return (ordered.unionByName(players)
            .groupBy(F.col("gameid").alias("game_id"), F.col("teamname").alias("team"), "champion")
            .agg(last_known("position"), last_known("pick_order")))


def match_bans(csv: DataFrame) -> DataFrame:
    """Bans per (game, team, champion); the first order is kept."""
    return (_slots(csv, "ban")
            .groupBy(F.col("gameid").alias("game_id"), F.col("teamname").alias("team"), "champion")
            .agg(F.min_by("slot", F.struct("file", "row", "slot")).alias("ban_order")))


def load_match_csv(spark: SparkSession, paths: str | list[str]) -> dict[str, DataFrame]:
    csv = read_match_csv(spark, paths)
    return {"oe_games": match_games(csv), "oe_picks": match_picks(csv), "oe_bans": match_bans(csv)}


def reload_games(stored: DataFrame, loaded: DataFrame) -> DataFrame:
    """A later load over stored games: new games are added, known ones change winner and date."""
    return partial_upsert(stored, loaded, ["game_id"], ["winner", "date_utc"])
