"""What keeps the queries over drafts linear in their input: their plans, and equal results of the shorter way."""

import os

import pytest
from helpers import same
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.operators.deltas import odds_around, odds_of_starts
from marketlake.operators.features import training_rows
from marketlake.plans import draft, stores, trading
from marketlake.plans.registry import QUERIES, Tables
from marketlake.session import RUNTIME_CONF


def plan(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_sides_gathered_once_equal_training_rows(spark, sf_dir):
    t = Tables(spark, sf_dir)
    cols = ["oe_game_id", "team", "opponent", "patch", "own_picks", "enemy_picks", "own_bans", "enemy_bans"]
    want = training_rows(draft.side_deltas(t), draft.side_games(t), draft.side_picks(t), draft.side_bans(t))
    got = draft.draft_rows(t)
    assert got.columns == want.columns and want.count() > 100 and same(got.select(*cols), want.select(*cols))


@pytest.mark.parametrize("name", ["training_rows", "feature_support", "gram_matrix", "gram_target"])
def test_lines_are_read_once(spark, sf_dir, name):
    assert plan(spark, sf_dir, name).count("FileScan parquet [l_") == 1


def test_no_gathering_of_features_by_row(spark, sf_dir):
    assert "collect_set(feature" not in plan(spark, sf_dir, "gram_matrix")
    assert "__rest" not in plan(spark, sf_dir, "score_states")


def test_model_meets_features_without_a_shuffle(spark, sf_dir):
    assert "SortMergeJoin [feature" not in plan(spark, sf_dir, "ridge_residual")


def test_fit_holds_no_rows_in_memory_and_moves_none(spark, sf_dir, monkeypatch):
    def persist(self, *level):
        raise AssertionError("rows are cached on the executors")

    for kind in {DataFrame, type(spark.range(1))}:
        monkeypatch.setattr(kind, "persist", persist)
    shown = plan(spark, sf_dir, "ridge_residual")
    assert "SortMergeJoin" not in shown and "FileScan parquet" in shown and "own_picks" not in shown


def test_shares_of_tasks_are_bounded(spark):
    assert int(RUNTIME_CONF["spark.sql.adaptive.coalescePartitions.initialPartitionNum"]) >= 1000
    assert RUNTIME_CONF["spark.sql.adaptive.advisoryPartitionSizeInBytes"] == "12m" and RUNTIME_CONF["spark.sql.files.maxPartitionBytes"] == "32m"


def test_ticks_of_deltas_are_read_once(spark, sf_dir):
    # Once for the token and once for the ticker platform.
    assert plan(spark, sf_dir, "draft_deltas").count("FileScan parquet [l_") == 2


def test_odds_of_starts_equal_as_of_odds(spark):
    at = "timestamp_seconds(100000 + id * 37 % 4000)"
    ticks = spark.range(3000).selectExpr("IF(id % 2 = 0, 'a', 'b') AS platform", "cast(id % 40 AS string) AS market_id", f"{at} AS ts",
                                         "IF(id % 11 = 0, NULL, cast(id % 3 AS int)) AS resolution", "IF(id % 13 = 0, NULL, id / 3000D) AS p")
    matched = spark.range(60).selectExpr("IF(id % 2 = 0, 'a', 'b') AS platform", "cast(id AS string) AS market_id", "100000 + id * 70 AS game_start")
    want = odds_around(matched, ticks).filter("pre_p is not null or post_p is not null")
    got = odds_of_starts(matched, ticks).filter("pre_p is not null or post_p is not null")
    assert want.count() > 30 and same(got, want)


def test_members_of_trades_are_taken_out_once(spark, sf_dir):
    assert plan(spark, sf_dir, "ticker_trades").count("$.created_time") == 1


def test_match_files_are_small_and_whole(spark, sf_dir, tmp_path, monkeypatch):
    kept = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(kept)
    monkeypatch.setattr(stores, "scratch_path", lambda session, name: f"{tmp_path}/{name}")
    QUERIES["match_files"](spark, sf_dir)
    assert spark.conf.get(kept) == before
    given = sum(os.path.getsize(f"{sf_dir}/{name}.parquet") for name in ("lineitem", "orders", "part"))
    written = {str(p): p.stat().st_size for p in (tmp_path / "matches").rglob("part-*")}
    assert sum(written.values()) < 2 * given
    rows = trading.match_csv(Tables(spark, sf_dir)).drop("file", "row").withColumn("key", F.col("gameid").cast("long"))
    for load, left_out in (("a", 0), ("b", 1)):
        read = spark.read.option("header", True).csv(f"{tmp_path}/matches/load={load}").withColumn("at", F.input_file_name())
        assert read.groupBy("gameid").agg(F.countDistinct("at").alias("n")).filter("n > 1").count() == 0
        moved = [] if load == "a" else ["date", "result"]
        columns = [F.trim(c).alias(c) for c in rows.columns if c not in ["key", *moved]]
        want = rows.filter(f"key % 3 <> {left_out}")
        assert want.count() > 1000 and same(read.select(columns), want.select(columns))
        if load == "b":
            assert read.filter("(result = '1') <> (side = 'Red')").count() == 0
            at, dated = (x.select("gameid", F.to_timestamp("date").alias("date")).distinct() for x in (read, want))
            assert at.join(dated.withColumnRenamed("date", "old"), "gameid").filter("date <> old + INTERVAL 1 DAY").count() == 0


def test_lines_of_match_files_are_joined_once(spark, sf_dir):
    shown = trading.match_loads(Tables(spark, sf_dir), lines_per_part=500)._jdf.queryExecution().executedPlan().toString()
    assert shown.count("FileScan parquet [l_") == 1 and shown.count("Exchange hashpartitioning(l_orderkey") == 1
