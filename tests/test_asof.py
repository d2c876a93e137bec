import random

import pytest
from helpers import rows, same, ts
from pyspark.sql import functions as F

from marketlake.operators.asof import asof_backward, asof_cutoff, nearest

TICKS = "k string, t bigint, res int, p double"


@pytest.fixture(scope="module")
def ticks(spark):
    return spark.createDataFrame([
        ("a", 100, 10, 0.1), ("a", 200, 10, 0.2), ("a", 200, 1, 0.25), ("a", 300, 1, None),
        ("b", 500, 1, 0.9), (None, 10, 1, 0.7), ("c", None, 1, 0.3)], TICKS)


def probes(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k string, at bigint")


def test_tie_null_boundary_and_missing(spark, ticks):
    got = asof_backward(probes(spark, ("a", 99), ("a", 100), ("a", 250), ("a", 300), ("b", 499), ("z", 1), (None, 99), ("c", 9)),
                        ticks, ["k"], "at", "t", ["p"], tie="res", at="tick")
    assert rows(got) == rows(spark.createDataFrame([
        ("a", 99, None, None), ("a", 100, 0.1, 100), ("a", 250, 0.25, 200), ("a", 300, None, 300),
        ("b", 499, None, None), ("z", 1, None, None), (None, 99, None, None), ("c", 9, None, None)],
        "k string, at bigint, p double, tick bigint"))


def test_earliest_does_not_fall_through(spark, ticks):
    got = asof_backward(probes(spark, ("a", 250), ("a", 199)), ticks, ["k"], "at", "t", ["p"], tie="res",
                        earliest=F.col("at") - 50)
    assert rows(got) == [("a", 199, None), ("a", 250, 0.25)]


def test_timestamps(spark):
    t = spark.createDataFrame([("a", ts(100), 0.5)], "k string, t timestamp_ntz, p double")
    p = spark.createDataFrame([("a", ts(100)), ("a", ts(99))], "k string, at timestamp")
    assert [r[2] for r in rows(asof_backward(p, t, ["k"], "at", "t", ["p"]))] == [None, 0.5]


def brute(pr, tk):
    out = []
    for i, k, at in pr:
        seen = [(t, -res, p) for kk, t, res, p in tk if kk == k and t <= at]
        out.append((i, k, at, max(seen)[2] if seen else None))
    return out


@pytest.mark.parametrize("rows_per_segment", [None, 20, 77])
def test_hot_keys_equal_brute_force(spark, rows_per_segment):
    """One key with most rows, repeated ticks of one instant, and a third of the probes equal."""
    rng = random.Random(5)
    tk = []
    for k, n in (("hot", 400), ("b", 30), ("c", 5)):
        seen = set()
        for _ in range(n):
            t, res = rng.randrange(300), rng.choice([1, 10, 60])
            if (t, res) not in seen:
                seen.add((t, res))
                tk.append((k, t, res, round(rng.random(), 3)))
    pr = [(i, rng.choice(["hot", "hot", "b", "c", "d"]), rng.randrange(-10, 320)) for i in range(300)]
    pr += [(1000 + i, "hot", 150) for i in range(150)]
    p = spark.createDataFrame(pr, "i int, k string, at bigint")
    t = spark.createDataFrame(tk, TICKS)
    got = asof_backward(p, t, ["k"], "at", "t", ["p"], tie="res", rows_per_segment=rows_per_segment)
    assert rows(got) == sorted(brute(pr, tk), key=lambda r: tuple((v is not None, str(v)) for v in r))


def test_cutoff_per_key(spark, ticks):
    cut = spark.createDataFrame([("a", 200), ("b", 499), ("c", 5)], "k string, cut bigint")
    got = asof_cutoff(ticks, cut, ["k"], "cut", "t", ["p"], tie="res", at="tick")
    assert rows(got) == [("a", 0.25, 200)]


def test_nearest_ties_and_tolerance(spark):
    games = spark.createDataFrame([("x", 100, "g2"), ("x", 300, "g1"), ("x", 300, "g0"), ("y", 0, "h")], "k string, d bigint, g string")
    p = spark.createDataFrame([("x", 200), ("x", 301), ("x", 99), ("y", 43200), ("y", 43201), ("x", 10**6)], "k string, at bigint")
    got = nearest(p, games, ["k"], "at", "d", ["g"], tie="g", tolerance=43200)
    assert rows(got, "k", "at", "distance", "g") == sorted([
        ("x", 200, 100, "g0"), ("x", 301, 1, "g0"), ("x", 99, 1, "g2"), ("y", 43200, 43200, "h")],
        key=lambda r: tuple((v is not None, str(v)) for v in r))


def test_nearest_hot_equals_plain(spark):
    rng = random.Random(1)
    g = spark.createDataFrame([("x" if i % 3 else "y", rng.randrange(1000), f"g{i:03d}") for i in range(300)], "k string, d bigint, g string")
    p = spark.createDataFrame([(i, "x" if i % 4 else "y", rng.randrange(1100)) for i in range(300)], "i int, k string, at bigint")
    plain = nearest(p, g, ["k"], "at", "d", ["g"], tie="g", tolerance=50, rows_per_segment=None)
    hot = nearest(p, g, ["k"], "at", "d", ["g"], tie="g", tolerance=50, rows_per_segment=25)
    assert plain.count() > 100 and same(plain, hot)


def test_ticks_of_keys_nobody_asks_for_are_dropped_by_any_join(spark, ticks):
    """With and without a broadcast of the probed keys the result is the same."""
    p = probes(spark, ("a", 250), ("b", 600), ("z", 1))
    few = rows(asof_backward(p, ticks, ["k"], "at", "t", ["p"], tie="res"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows(asof_backward(p, ticks, ["k"], "at", "t", ["p"], tie="res")) == few
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_one_key_at_one_instant(spark):
    """Ticks and probes that share key and time fall into many ranges; every probe finds the smallest tie."""
    t = spark.range(0, 3000, 1, 4).selectExpr("'a' as k", "50L as t", "cast(id as int) as res", "cast(id as double) as p")
    t = t.union(spark.createDataFrame([("a", 10, 1, -1.0), ("b", 60, 1, -2.0)], TICKS))
    p = spark.range(0, 3000, 1, 4).selectExpr("cast(id as int) as i", "if(id < 10, 'b', 'a') as k", "if(id % 100 = 0, 49L, 50L) as at")
    got = asof_backward(p, t, ["k"], "at", "t", ["p"], tie="res", rows_per_segment=150)
    plain = asof_backward(p, t, ["k"], "at", "t", ["p"], tie="res", rows_per_segment=None)
    assert same(got, plain)
    assert {(r["k"], r["at"], r["p"]) for r in got.select("k", "at", "p").distinct().collect()} == {
        ("a", 50, 0.0), ("a", 49, -1.0), ("b", 49, None), ("b", 50, None)}


def test_building_an_asof_join_starts_no_job(spark, ticks):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("asof-building", "plan")
    try:
        asof_backward(probes(spark, ("a", 250)), ticks, ["k"], "at", "t", ["p"], tie="res")
        assert len(tracker.getJobIdsForGroup("asof-building")) == 0
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
