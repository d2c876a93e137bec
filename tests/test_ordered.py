import random

import pytest
from helpers import rows, same
from pyspark.sql import functions as F

from marketlake.operators.intervals import halts_from_status
from marketlake.operators.ordered import Sum, cut_index, find_cuts, neighbour, running
from marketlake.operators.scoring import prefix_sets
from marketlake.operators.series import change_only


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    data = [("hot" if i % 3 else f"k{i % 7}", rng.randrange(500), i, rng.choice("AAB")) for i in range(1200)]
    return spark.createDataFrame(data, "k string, t bigint, seq int, v string").repartition(5)


def test_cut_index(spark):
    df = spark.createDataFrame([(x,) for x in (0, 9, 10, 15, 20, 99)], "x bigint")
    got = df.select("x", cut_index(F.array(*[F.lit(c).cast("bigint") for c in (10, 20, 30)]), F.col("x")).alias("i"))
    assert rows(got) == sorted([(0, 0), (9, 0), (10, 1), (15, 1), (20, 2), (99, 3)], key=lambda r: (str(r[0]), str(r[1])))


def jobs(spark, build):
    """What ``build`` returns, and how many jobs it starts."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "plan")
    try:
        made = build()
        return made, len(tracker.getJobIdsForGroup("building"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_ranges_are_balanced_and_small_tables_are_one(spark, skewed):
    order = ["t", "seq"]
    assert find_cuts(skewed, ["k"], order, None) is None
    one = find_cuts(skewed, ["k"], order, 10_000)
    assert one.bounds.first()["__cuts"] == [] and one.split(skewed).count() == 0
    assert one.assign(skewed).select("__segment").distinct().count() == 1
    cuts = find_cuts(skewed, ["k"], order, 100)
    ranges = cuts.assign(skewed).groupBy("__segment").agg(F.count("*").alias("n"), F.min(F.struct("k", *order)), F.max(F.struct("k", *order))).orderBy("__segment").collect()
    assert len(ranges) >= 6 and max(r["n"] for r in ranges) <= 300
    assert all(tuple(a[3]) < tuple(b[2]) for a, b in zip(ranges, ranges[1:]))
    assert cuts.bounds.first() == find_cuts(skewed.repartition(3), ["k"], order, 100).bounds.first()


def test_building_a_plan_starts_no_job(spark, skewed):
    df = skewed.withColumn("a", F.col("v") == "A")
    for build in (lambda: change_only(skewed, ["k"], ["t", "seq"], "v", 60),
                  lambda: halts_from_status(df, ["k"], ["t", "seq"], "a", rows_per_segment=60),
                  lambda: prefix_sets(skewed, ["k"], ["t", "seq"], "v", cuts=find_cuts(skewed, ["k"], ["t", "seq"], 60))):
        made, n = jobs(spark, build)
        assert n == 0 and made.columns


def test_one_key_at_one_instant_is_cut(spark):
    """All rows share key and time; the sequence alone tells them apart."""
    df = spark.range(0, 6000, 1, 6).selectExpr("cast(null as string) as k", "7L as t", "cast(id as int) as seq", "if(id % 5 < 2, 'A', 'B') as v")
    order = ["t", "seq"]
    cuts = find_cuts(df, ["k"], order, 400)
    sizes = [r["count"] for r in cuts.assign(df).groupBy("__segment").count().collect()]
    assert len(sizes) >= 10 and max(sizes) <= 1200
    assert same(neighbour(df, ["k"], order, "v", "n"), neighbour(df, ["k"], order, "v", "n", cuts=cuts))
    assert same(change_only(df, ["k"], order, "v", None), change_only(df, ["k"], order, "v", 400))
    assert same(prefix_sets(df, ["k"], order, "v"), prefix_sets(df, ["k"], order, "v", cuts=cuts))
    plan = change_only(df, ["k"], order, "v", 400)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(__segment" in plan and "SinglePartition" in plan and "NestedLoop" not in plan


def test_many_equal_hot_keys_and_a_null_key_are_cut(spark):
    data = [(None if k == 0 else f"k{k}", t, t, "AB"[t % 2]) for k in range(60) for t in range(100)]
    df = spark.createDataFrame(data, "k string, t bigint, seq int, v string").repartition(5)
    cuts = find_cuts(df, ["k"], ["t", "seq"], 25)
    sizes = cuts.assign(df).groupBy("k", "__segment").count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] <= 80 and sizes[1] >= 120
    assert same(neighbour(df, ["k"], ["t", "seq"], "v", "n"), neighbour(df, ["k"], ["t", "seq"], "v", "n", cuts=cuts))
    fold = lambda: F.sum("seq")
    assert same(running(df, ["k"], ["t", "seq"], "s", fold, Sum), running(df, ["k"], ["t", "seq"], "s", fold, Sum, cuts))


@pytest.mark.parametrize("direction", ["previous", "next"])
def test_neighbour(spark, skewed, direction):
    plain = neighbour(skewed, ["k"], ["t", "seq"], "v", "n", direction, found="f")
    cut = neighbour(skewed, ["k"], ["t", "seq"], "v", "n", direction, find_cuts(skewed, ["k"], ["t", "seq"], 60), found="f")
    assert same(plain, cut)


def test_running_sum(spark, skewed):
    fold = lambda: F.sum("seq")
    plain = running(skewed, ["k"], ["t", "seq"], "s", fold, Sum)
    assert same(plain, running(skewed, ["k"], ["t", "seq"], "s", fold, Sum, find_cuts(skewed, ["k"], ["t", "seq"], 60)))


def test_prefix_sets(spark, skewed):
    plain = prefix_sets(skewed, ["k"], ["t", "seq"], "v")
    assert same(plain, prefix_sets(skewed, ["k"], ["t", "seq"], "v", cuts=find_cuts(skewed, ["k"], ["t", "seq"], 60)))


def test_change_only(spark, skewed):
    data = [("m", 1, 0, "A"), ("m", 2, 1, "A"), ("m", 3, 2, "B"), ("m", 4, 3, "A"), ("n", 9, 4, None), ("n", 10, 5, None)]
    df = spark.createDataFrame(data, skewed.schema)
    assert [r[2] for r in rows(change_only(df, ["k"], ["t", "seq"], "v"))] == [0, 2, 3, 4]
    assert same(change_only(skewed, ["k"], ["t", "seq"], "v", None), change_only(skewed, ["k"], ["t", "seq"], "v", 60))


def test_halts(spark, skewed):
    polls = spark.createDataFrame([("p", 1, True), ("p", 2, False), ("p", 3, None), ("p", 4, False), ("p", 5, True), ("p", 6, False),
                                   ("q", 1, False), ("r", 1, None)], "k string, t bigint, a boolean")
    assert rows(halts_from_status(polls, ["k"], ["t"], "a")) == [("p", 2, 5), ("p", 6, None), ("q", 1, None)]
    df = skewed.withColumn("a", F.col("v") == "A")
    assert same(halts_from_status(df, ["k"], ["t", "seq"], "a", rows_per_segment=None),
                halts_from_status(df, ["k"], ["t", "seq"], "a", rows_per_segment=60))
