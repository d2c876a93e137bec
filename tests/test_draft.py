"""Draft study: matching, odds, rankings, features, ridge and scoring against plain Python."""

import random

import numpy as np
import pytest
from helpers import logit, rows, same, ts
from pyspark.sql import functions as F
from test_tables import KA, PM, markets

from marketlake import schemas as S
from marketlake.operators import deltas as D
from marketlake.operators import features as FE
from marketlake.operators import rankings as R
from marketlake.operators import ridge as RI
from marketlake.operators import scoring as SC

CHAMPS = [f"C{i}" for i in range(12)]


@pytest.fixture(scope="module")
def season(spark):
    rng = random.Random(2)
    games, picks, bans, deltas = [], [], [], []
    for g in range(160):
        pool = rng.sample(CHAMPS, 8)
        patch = rng.choice(["16.9", "16.10", "16.8", ""])
        games.append((f"g{g}", "LCK", 1000 * g, 1, patch or None, "X", "Y", "X"))
        for team, other, mine, banned in (("X", "Y", pool[:3], pool[6:7]), ("Y", "X", pool[3:6], pool[7:8])):
            for i, c in enumerate(mine):
                picks.append((f"g{g}", team, c, rng.choice(["top", "mid", None]), i))
            for c in banned:
                bans.append((f"g{g}", team, c, 1))
            pre = rng.uniform(0.1, 0.9)
            for platform in (KA, PM):
                post = min(0.99, max(0.0, pre + rng.gauss(0, 0.05)))
                deltas.append((platform, f"{g}{team}", f"g{g}", team, other, None if g == 0 else "LCK", 0, 1, pre, post, round(post - pre, 4), g % 2))
    return {"games": spark.createDataFrame(games, S.MATCH_GAMES), "picks": spark.createDataFrame(picks, S.MATCH_PICKS),
            "bans": spark.createDataFrame(bans, S.MATCH_BANS), "deltas": spark.createDataFrame(deltas, S.DRAFT_DELTAS)}


# ------------------------------------------------------------------ deltas

def test_candidates(spark):
    k = {"platform": KA, "series": "KXLOLMAP", "status": "settled", "result": "no", "game_start_ts": 1, "outcome": "T1", "title": "Will T1 win MAP 2?"}
    p = {"platform": PM, "status": "closed", "game_start_ts": 1, "outcome": "T1", "title": "LoL: game 3 winner"}
    m = markets(spark, {**k, "market_id": "k"}, {**k, "market_id": "k1", "series": "KXLOLGAME"}, {**k, "market_id": "k2", "result": None},
                {**k, "market_id": "k3", "title": "x"}, {**p, "market_id": "p"}, {**p, "market_id": "p1", "outcome": "Yes"},
                {**p, "market_id": "p2", "outcome": None}, {**p, "market_id": "p3", "game_start_ts": None})
    assert rows(D.map_winner_candidates(m), "market_id", "map_n") == [("k", 2), ("p", 3)]


def test_build_deltas(spark):
    start = 100_000
    games = spark.createDataFrame([
        ("far", "LCK", start + 4200 + 43200, 2, "1", "T1", "Gen.G", "T1"), ("near", "LCK", start + 4300, 2, "1", "Gen.G", "T1 Esports", "Gen.G"),
        ("other", "LCK", start + 4200, 1, "1", "T1", "Gen.G", "T1"), ("nowinner", "LCK", start + 4200, 2, "1", "T1", "Gen.G", None)], S.MATCH_GAMES)
    k = {"platform": KA, "series": "KXLOLMAP", "status": "settled", "result": "yes", "game_start_ts": start, "title": "map 2"}
    m = markets(spark, {**k, "market_id": "a", "outcome": "T1"}, {**k, "market_id": "b", "outcome": "Gen G"}, {**k, "market_id": "c", "outcome": "Other"},
                {**k, "market_id": "stale", "outcome": "T1"})
    g = start + 4300
    q = '{"yes_bid":{"close_dollars":"0.40"},"yes_ask":{"close_dollars":"0.50"}}'
    ca = spark.createDataFrame([(KA, mk, 1, ts(t), None, None, None, c, 0.0, 0.0, r) for mk, t, c, r in (
        ("a", g - 960, 0.1, q), ("a", g - 959, 0.2, "{}"), ("a", g + 120, 0.7, "{}"), ("a", g + 121, 0.9, "{}"),
        ("b", g - 2000, 0.6, "{}"), ("b", g - 500, 0.5, "{}"), ("stale", g - 961, 0.5, "{}"), ("c", g, 0.5, "{}"))], S.CANDLES)
    pp = spark.createDataFrame([], S.PRICE_POINTS)
    got = D.build_deltas(m, games, pp, ca)
    assert rows(got, "market_id", "oe_game_id", "team", "opponent", "pre_p", "post_p", "delta", "won") == [
        ("a", "near", "T1 Esports", "Gen.G", 0.45, 0.7, 0.25, 0), ("b", "near", "Gen.G", "T1 Esports", 0.6, 0.5, -0.1, 1)]
    assert same(got, D.build_deltas(m, games, pp, ca, rows_per_segment=1))


# ------------------------------------------------------------------ rankings

def test_rankings(season):
    g = R.per_game(season["deltas"])
    assert g.count() == 318  # the game without a league never passes
    assert R.per_game(season["deltas"], platform=KA, leagues="lpl").count() == 0
    top = R.team_ranking(g).collect()
    assert {r["team"] for r in top} == {"X", "Y"} and all(r["n"] == 159 for r in top)
    assert R.team_ranking(g, 160).count() == 0
    champs = R.champion_ranking(g, season["picks"])
    mine = g.join(season["picks"].withColumnRenamed("game_id", "oe_game_id"), ["oe_game_id", "team"]).toPandas()
    want = mine.groupby("champion").delta.agg(["mean", "size"])
    for r in champs.collect():
        assert r["n"] == want.loc[r["champion"], "size"] and abs(r["avg_delta"] - want.loc[r["champion"], "mean"]) < 6e-5
    pairs = R.pair_ranking(g, season["picks"], 1)
    assert pairs.agg(F.sum("n")).first()[0] == 318 * 3 and pairs.filter("c1 >= c2").count() == 0
    cut = R.top_bottom_k(champs, "avg_delta", ["champion"], 2)
    assert rows(cut.groupBy("part").count()) == [("bottom", 2), ("top", 2)]
    assert R.top_bottom_k(champs, "avg_delta", ["champion"], 100).count() == champs.count()
    assert [r["n"] for r in R.top_by(champs, "n", ["champion"], 3).collect()] == sorted((r["n"] for r in champs.collect()), reverse=True)[:3]


# ------------------------------------------------------------------ features

def test_feature_names(spark):
    states = spark.createDataFrame(
        [(1, ["A", "B"], ["C"], {"A": "top"}, {}, ["D"], [], "16.9"), (2, ["B"], ["A", "C"], {}, {"C": ""}, [], [], "")],
        "id int, own_picks array<string>, enemy_picks array<string>, own_roles map<string,string>, enemy_roles map<string,string>, "
        "own_bans array<string>, enemy_bans array<string>, patch string")
    got = {r["id"]: sorted(r["features"]) for r in FE.with_features(states, ["id"]).collect()}
    assert got[1] == sorted(["own_pick:A", "own_pick:A@top", "own_pick:A#16.9", "own_pick:B", "own_pick:B#16.9", "enemy_pick:C",
                             "enemy_pick:C#16.9", "own_ban:D", "own_ban:D#16.9", "syn:A|B", "vs:A|C", "vs:B|C"])
    assert got[2] == sorted(["own_pick:B", "enemy_pick:A", "enemy_pick:C", "vs:B|A", "vs:B|C"])


def test_features(season):
    data = FE.training_rows(season["deltas"], season["games"], season["picks"], season["bans"])
    assert data.count() == 320
    one = season["deltas"].filter("oe_game_id = 'g5' AND team = 'X'").toPandas()
    y = data.filter("oe_game_id = 'g5' AND team = 'X'").first()["y"]
    assert abs(y - (logit(one.post_p.mean()) - logit(one.pre_p.mean()))) < 1e-12
    kept = FE.feature_support(FE.explode_features(data, ["team"]), 25)
    assert kept.filter("feature LIKE 'own_pick:%' AND feature NOT LIKE '%@%' AND feature NOT LIKE '%#%'").count() == 12
    assert kept.filter(FE.is_interaction(F.col("feature"))).agg(F.min("n")).first()[0] >= 25
    assert rows(FE.newest_patches(data)) == [("16.10",), ("16.9",)]
    split = FE.newest_split(data)
    assert split.count() == 320 and split.filter("is_test AND patch NOT IN ('16.9', '16.10')").count() == 0


def test_missing_side_is_dropped(season):
    x_only = season["picks"].filter("team = 'X'")
    assert FE.training_rows(season["deltas"], season["games"], x_only, season["bans"]).count() == 0


# ------------------------------------------------------------------ ridge

@pytest.mark.parametrize("dense_limit", [4096, 0])
def test_ridge_equals_normal_equations(spark, season, dense_limit):
    data = FE.training_rows(season["deltas"], season["games"], season["picks"], season["bans"])
    states = FE.with_features(data, ["oe_game_id", "team", "y"]).withColumn("features", F.concat("features", F.array(F.lit("every_row"))))
    vocab = RI.vocabulary(FE.feature_support(states.select(F.explode("features").alias("feature")), 20))
    vectors = RI.vectorize(states, [f for f, _ in vocab])
    got = RI.ridge(vectors, 30.0, dense_limit=dense_limit).coefficients.toArray()
    local = vectors.select("x", "y").collect()
    x, y = np.array([r["x"].toArray() for r in local]), np.array([r["y"] for r in local])
    want = np.linalg.solve(x.T @ x + 30.0 * np.eye(x.shape[1]), x.T @ y)
    assert np.abs(got - want).max() < 1e-6
    gram = {(r["f1"], r["f2"]): r["n"] for r in RI.gram_matrix(
        states.select("oe_game_id", "team", F.explode("features").alias("feature")), ["oe_game_id", "team"]).collect()}
    names = [f for f, _ in vocab]
    xx = x.T @ x
    assert all(gram.get((names[i], names[j]), 0) == xx[i, j] for i in range(0, len(names), 7) for j in range(i, len(names), 5))


def test_fit_and_meta(season):
    data = FE.training_rows(season["deltas"], season["games"], season["picks"], season["bans"])
    model = {r["feature"]: r for r in RI.fit_ridge(data).collect()}
    assert model["__meta__"]["n"] == 320 and model["__meta__"]["coef"] < 0.5
    assert model["__meta_time__"]["n"] == data.filter("patch IN ('16.9','16.10')").count()
    few = RI.fit_ridge(data.limit(50)).collect()
    assert [(r["feature"], r["coef"], r["n"]) for r in few] == [("__status__", None, 50)]
    frame = RI.fit_ridge(data, evaluate=False, min_n=5)
    assert {r[0] for r in FE.model_champions(frame).collect()} == set(CHAMPS)
    assert [r[0] for r in FE.model_patches(frame).collect()] == ["16.10", "16.9", "16.8"]


def test_residuals_show_what_a_fit_leaves(season):
    data = FE.training_rows(season["deltas"], season["games"], season["picks"], season["bans"])
    vectors, vocab, n = RI.design_matrix(data, ["y"], 20)
    model = RI.ridge(vectors, 30.0)
    coefs = dict(zip([f for f, _ in vocab], RI.coefficients(model, len(vocab))))
    left = {r["feature"]: r for r in RI.residuals(vectors, vocab, model, 30.0).collect()}
    assert n == 320 and {f: r["n"] for f, r in left.items()} == dict(vocab) and max(abs(r["residual"]) for r in left.values()) < 1e-6
    other = RI.residuals(vectors, vocab, model, 10.0).collect()
    assert max(abs(r["residual"] + 20 * coefs[r["feature"]]) for r in other) < 1e-6 < max(abs(r["residual"]) for r in other)
    target = {r["feature"]: r["xty"] for r in RI.gram_target(FE.explode_features(data, ["y"])).collect()}
    assert all(abs(r["residual"] + target[r["feature"]]) < 1e-9 for r in RI.residuals(vectors, vocab, None).collect())
    assert RI.design_matrix(data.limit(0), ["y"]) == (None, [], 0)


# ------------------------------------------------------------------ scoring

def test_steps_of_written_drafts(spark):
    """Probabilities worked out by hand: sigmoid(logit(pre) + sum of the active coefficients)."""
    model = spark.createDataFrame([
        ("own_ban:A", 0.1, 30), ("own_ban:A#16.9", 0.05, 30), ("enemy_pick:B", -0.2, 30), ("enemy_pick:B@top", -0.1, 30),
        ("own_pick:C", 0.3, 30), ("vs:C|B", 0.05, 30), ("own_pick:D", -0.15, 30), ("own_pick:D#16.9", 0.02, 30), ("syn:C|D", 0.2, 30),
        ("enemy_ban:E", 0.4, 30), ("own_pick:C1", 0.5, 30), ("own_pick:C10", -0.3, 30), ("__meta__", 0.1, 5)], S.DRAFT_MODEL)
    actions = spark.createDataFrame([
        (1, 1, "blue", "BAN", " A ", "", 0.5, "16.9"), (1, 2, "Red", "pick", "B", "top", 0.5, "16.9"),
        (1, 3, "blue", "pick", "C", "", 0.5, "16.9"), (1, 4, "blue", "pick", "D", "mid", 0.5, "16.9"),
        (2, 1, "blue", "pick", "Z", "top", 0.7, ""), (2, 2, "red", "ban", "", "", 0.7, ""), (2, 3, "red", "ban", "E", "", 0.7, ""),
        (3, 1, "blue", "pick", "C10", "", 0.001, "")], S.DRAFT_ACTIONS)
    got = {(r["draft_id"], r["step"]): (r["p_blue"], r["dp_blue"], r["known"], [x["feature"] for x in (r["terms"] or [])])
           for r in SC.score_draft_steps(actions, model).collect()}
    want = {
        (1, 1): (0.5374, 0.0374, True, ["own_ban:A", "own_ban:A#16.9"]),
        (1, 2): (0.4626, -0.0749, True, ["enemy_pick:B", "enemy_pick:B@top"]),
        (1, 3): (0.5498, 0.0873, True, ["own_pick:C", "vs:C|B"]),
        (1, 4): (0.5671, 0.0173, True, ["syn:C|D", "own_pick:D", "own_pick:D#16.9"]),
        (2, 1): (0.7, 0.0, False, []),
        (2, 3): (0.7768, 0.0768, True, ["enemy_ban:E"]),
        (3, 1): (0.0149, 0.0049, True, ["own_pick:C10"]),
    }
    assert got == want


def test_whole_state_equals_last_step(spark, season):
    data = FE.training_rows(season["deltas"], season["games"], season["picks"], season["bans"]).withColumn("pre_p", F.lit(0.4))
    model = spark.createDataFrame([("own_pick:C1", 0.2, 9), ("vs:C1|C2", -0.1, 9), ("__meta__", 5.0, 1)], S.DRAFT_MODEL)
    got = SC.score_states(data, model, ["oe_game_id", "team"])
    for r in got.select("own_picks", "enemy_picks", "effect").collect():
        want = (0.2 + (-0.1 if "C2" in r["enemy_picks"] else 0)) if "C1" in r["own_picks"] else 0
        assert abs(r["effect"] - want) < 1e-12


def test_prefix_state(spark):
    df = spark.createDataFrame([(1, 1, "B", "pick", "A"), (1, 2, "R", "ban", "B"), (1, 3, "B", "pick", "C")],
                               "draft_id int, step int, side string, action string, champion string")
    got = SC.prefix_state(df).orderBy("step").collect()
    assert [(r["own_picks"], r["enemy_bans"]) for r in got] == [(["A"], []), (["A"], ["B"]), (["A", "C"], ["B"])]
