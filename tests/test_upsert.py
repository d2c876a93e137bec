"""Write rules on stored weeks: untouched files stay, repeated batches write nothing."""

import glob

from helpers import rows, ts

from marketlake.sinks import upsert as U

SCHEMA = "platform string, market_id string, ts timestamp, price double, n int"
WEEK = 7 * 86_400


def frame(spark, *data):
    return spark.createDataFrame([(p, m, ts(t), x, n) for p, m, t, x, n in data], SCHEMA)


def files(path):
    return set(glob.glob(f"{path}/*/*/*.parquet"))


def stored(spark, path):
    return rows(spark.read.parquet(path), "market_id", "price", "n")


def test_only_changed_weeks_are_written(spark, tmp_path):
    path, keys = f"{tmp_path}/s", ["platform", "market_id", "ts"]
    rule = U.latest(keys, ["n"])
    first = frame(spark, *[("p", f"m{k}", k * WEEK, 0.1 * k, 0) for k in range(5)], ("q", "m9", 0, 0.9, 0))
    assert U.upsert(first, path, rule) == 6
    before = files(path)
    change = frame(spark, ("p", "m1", WEEK, 0.7, 2), ("p", "m1", WEEK, 0.8, 1), ("p", "x", 3 * WEEK, 0.5, 1), ("p", "m4", 4 * WEEK, 0.4, 0))
    assert U.upsert(change, path, rule) == 2
    after = files(path)
    gone = {f.rsplit("/", 2)[0] for f in before - after}
    assert len(before & after) >= 4 and len(gone) == 1
    assert stored(spark, path) == [("m0", 0.0, 0), ("m1", 0.7, 2), ("m2", 0.2, 0), ("m3", 0.1 * 3, 0), ("m4", 0.4, 0), ("m9", 0.9, 0), ("x", 0.5, 1)]
    assert U.upsert(change, path, rule) == 0 and files(path) == after


def test_other_rules(spark, tmp_path):
    path, keys = f"{tmp_path}/s", ["platform", "market_id", "ts"]
    U.upsert(frame(spark, ("p", "a", 5, 0.1, 1), ("p", "b", WEEK, 0.2, 1)), path, U.absent(keys, ["n"]))
    assert U.upsert(frame(spark, ("p", "a", 5, 0.9, 9), ("p", "c", 6, 0.3, 3), ("p", "c", 6, 0.4, 2)), path, U.absent(keys, ["n"])) == 1
    assert stored(spark, path) == [("a", 0.1, 1), ("b", 0.2, 1), ("c", 0.4, 2)]
    U.upsert(frame(spark, ("p", "a", 5, 0.5, 5), ("p", "d", 7, 0.6, 6)), path, U.partly(keys, ["price"]))
    assert stored(spark, path) == [("a", 0.5, 1), ("b", 0.2, 1), ("c", 0.4, 2), ("d", 0.6, 6)]
    U.upsert(frame(spark, ("p", "a", 5, None, 7), ("p", "z", 5, 1.0, 1)), path, U.patched(keys, ["price", "n"], ["n"]))
    assert stored(spark, path) == [("a", 0.5, 7), ("b", 0.2, 1), ("c", 0.4, 2), ("d", 0.6, 6)]


def test_rows_without_a_time(spark, tmp_path):
    path, rule = f"{tmp_path}/s", U.latest(["platform", "market_id"], ["n"])
    df = spark.createDataFrame([("p", "a", None, 0.1, 1), (None, "b", ts(9), 0.2, 1)], SCHEMA)
    assert U.upsert(df, path, rule) == 2 and U.upsert(df, path, rule) == 0
    assert stored(spark, path) == [("a", 0.1, 1), ("b", 0.2, 1)]
