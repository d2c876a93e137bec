"""The dyadic interval index against plain comparisons."""

import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from marketlake.operators import intervals


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(8)
    span = 40 * 86_400
    outages = []
    for i in range(120):
        lo = rng.randrange(-span, span)
        length = rng.choice([0, 1, 50, 4095, 4096, 4097, 86_400, 10 * 86_400])
        outages.append((rng.choice("pq"), i, lo, None if i % 17 == 0 else lo + length))
    outages += [("p", 900, 5, 4), ("r", 901, 0, 10**9), (None, 902, 0, 10)]
    games = [(rng.choice("pqs"), g, rng.randrange(-span, span)) for g in range(400)] + [("p", 500, None), ("p", 501, 0), ("r", 502, -1)]
    return (spark.createDataFrame(games, "platform string, game int, at bigint"),
            spark.createDataFrame(outages, "platform string, outage int, start_ts bigint, end_ts bigint"), games, outages)


def brute(games, outages, now, before, after):
    return sorted((g, o) for p, g, at in games for q, o, lo, hi in outages
                  if p == q and p is not None and at is not None and lo - after <= at <= (now if hi is None else hi) + before and lo - after <= (now if hi is None else hi) + before)


@pytest.mark.parametrize("before,after", [(0, 0), (2700, 28_800)])
def test_overlaps_equal_plain_comparisons(tables, before, after):
    g, o, games, outages = tables
    now = 30 * 86_400
    got = intervals.interval_overlap(g, o, ["platform"], "at", now, before=before, after=after)
    want = brute(games, outages, now, before, after)
    assert sorted((r["game"], r["outage"]) for r in got.collect()) == want and len(want) > 500
    hit = intervals.overlapping_games(g, o, ["platform"], "at", now, before=before, after=after)
    assert [r[0] for r in rows(hit, "game")] == [str(x) and x for x in sorted({a for a, _ in want}, key=lambda x: (True, str(x)))]


def test_covers_are_short_and_disjoint(spark):
    year = 365 * 86_400
    df = spark.createDataFrame([(0, 10 * year), (-3, 10**17), (7, 7), (8, 7), (4095, 4096), (-10**9, 10**9)], "lo bigint, hi bigint")
    for r in df.select("lo", "hi", intervals.dyadic_cover(F.col("lo"), F.col("hi")).alias("n")).collect():
        assert len(r["n"]) < 64 or r["hi"] == 10**17
        spans = sorted((x["node"] << (x["level"] + 12), (x["node"] + 1) << (x["level"] + 12)) for x in r["n"])
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        if r["lo"] > r["hi"]:
            assert not spans
        else:
            assert spans[0][0] == r["lo"] >> 12 << 12 and spans[-1][1] == ((r["hi"] >> 12) + 1) << 12


def test_no_job_and_no_pairs_of_all(tables):
    g, o, _, _ = tables
    plan = intervals.interval_overlap(g, o, ["platform"], "at", 10**6)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
