"""Streams over several micro-batches equal their batch twins."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from helpers import rows, same, ts
from pyspark.sql import functions as F

from marketlake.operators.intervals import halts_from_status
from marketlake.operators.merge import set_fields
from marketlake.operators.series import bucket_last, change_only, latest_per_key
from marketlake.sinks.log import Log
from marketlake.streaming import keyed, native
from marketlake.streaming.keyed import halt_table, stream_change_only, stream_halts
from marketlake.streaming.run import drain


@pytest.fixture(scope="module")
def landed(spark, sf_dir, tmp_path_factory):
    """The events in four files of consecutive times."""
    path = str(tmp_path_factory.mktemp("landing"))
    e = (spark.read.parquet(f"{sf_dir}/events.parquet")
         .withColumn("ts", F.col("ts").cast("timestamp")).withColumn("t", F.unix_micros("ts")))
    bounds = e.approxQuantile("t", [0.25, 0.5, 0.75], 0.001)
    edges = [None, *bounds, None]
    for lo, hi in zip(edges, edges[1:]):
        part = e
        part = part.filter(F.col("t") > lo) if lo is not None else part
        part = part.filter(F.col("t") <= hi) if hi is not None else part
        part.coalesce(1).write.mode("append").parquet(path)  # a small fixture file
    return path, e


def stream(spark, landed):
    path, e = landed
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.fixture(scope="module")
def jumbled(spark, landed, tmp_path_factory):
    """The events in six files by time plus up to ten minutes, then a row that lets the last ones go."""
    path, e = str(tmp_path_factory.mktemp("jumbled")), landed[1].select("event_id", "user_id", "t", "event_type")
    arrival = F.col("t") + F.pmod(F.xxhash64("event_id"), F.lit(599_000_000))
    edges = [None, *e.select(arrival.alias("x")).approxQuantile("x", [i / 6 for i in range(1, 6)], 0.001), None]
    for lo, hi in zip(edges, edges[1:]):
        part = e.filter(arrival > lo) if lo is not None else e
        (part.filter(arrival <= hi) if hi is not None else part).coalesce(1).write.mode("append").parquet(path)
    last = e.agg(F.max("t")).first()[0]
    spark.createDataFrame([(-1, -1, last + 7_200_000_000, "end")], e.schema).coalesce(1).write.mode("append").parquet(path)
    return path, e


def test_change_only_out_of_order(spark, jumbled):
    got = drain(stream_change_only(stream(spark, jumbled), ["user_id"], ["t", "event_id"], "event_type"), "t1")
    want = change_only(jumbled[1], ["user_id"], ["t", "event_id"], "event_type").select("event_id")
    assert got.filter("late").count() == 0 and same(got.filter("user_id >= 0").select("event_id"), want)


def test_change_only_seeded(spark, jumbled):
    first = jumbled[1].groupBy("user_id").agg(F.min_by("event_type", F.struct("t", "event_id")).alias("value")).withColumn("newest", F.lit(None).cast("long"))
    got = drain(stream_change_only(stream(spark, jumbled), ["user_id"], ["t", "event_id"], "event_type", seed=first), "t2")
    want = change_only(jumbled[1], ["user_id"], ["t", "event_id"], "event_type")
    assert got.filter("user_id >= 0").count() == want.count() - first.count()


def test_rows_not_newer_than_the_seed_are_late(spark, tmp_path):
    src = land(spark, f"{tmp_path}/in", "k string, t long, v string", [("a", 5_000_000, "x"), ("a", 6_000_000, "x"), ("a", 7_000_000, "y")],
               [("end", 9_000_000_000, "e")])
    seed = spark.createDataFrame([("a", "x", 5_000_000)], "k string, value string, newest long")
    got = drain(stream_change_only(src, ["k"], ["t"], "v", seed=seed), "t8")
    assert rows(got, "t", "v", "late") == [(5_000_000, "x", True), (7_000_000, "y", False)]


def test_late_rows_are_reported(spark, tmp_path):
    schema = "k string, t long, v string"
    hour = 3_600_000_000
    src = land(spark, f"{tmp_path}/in", schema, [("a", 2 * hour, "x")],
               [("a", hour, "y"), ("a", 2 * hour - 1_000_000, "x"), ("a", 2 * hour + 1, "z")], [("b", 9 * hour, "end")])
    got = drain(stream_change_only(src, ["k"], ["t", "v"], "v"), "t3")
    # The "x" one second earlier is the first row in order, so the other "x" is no change.
    assert rows(got.filter("k = 'a'"), "t", "v", "late") == [(hour, "y", True), (2 * hour - 1_000_000, "x", False), (2 * hour + 1, "z", False)]


def test_halts(spark, landed):
    polls = stream(spark, landed).select("user_id", "t", "event_id", (F.col("event_type") != "error").alias("active"))
    got = halt_table(drain(stream_halts(polls, ["user_id"], "t", "active", "event_id"), "t4"), ["user_id"])
    want = halts_from_status(landed[1].withColumn("active", F.col("event_type") != "error"), ["user_id"], ["t", "event_id"], "active")
    assert want.count() > 50 and same(got, want)


def land(spark, path, schema, *files):
    for data in files:
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_late_poll_does_not_end_a_halt_before_its_start(spark, tmp_path):
    src = land(spark, f"{tmp_path}/in", "k string, t long, q long, active boolean",
               [("a", 100, 1, False)], [("a", 50, 2, True)], [("a", 100, 1, True), ("a", 100, 3, True), ("a", 120, 4, False)],
               [("a", 110, 5, True), ("b", 7, 6, True), ("a", 130, 7, None), ("a", 140, 8, True)])
    got = drain(stream_halts(src, ["k"], "t", "active", "q"), "t7")
    assert rows(halt_table(got, ["k"]), "k", "start_ts", "end_ts") == [("a", 100, 100), ("a", 120, 140)]
    assert sorted(r["start_ts"] for r in got.filter("late").collect()) == [50, 100, 110]


def test_trade_sink_across_restarts(spark, landed, tmp_path):
    for run in ("c", "c", "other"):  # the same checkpoint again, then a new one on the same path
        s = stream(spark, landed).select("event_id", "ts", "value")
        native.start_trade_sink(s, f"{tmp_path}/o", f"{tmp_path}/{run}", ["event_id"], available_now=True).awaitTermination()
    stored = spark.read.parquet(f"{tmp_path}/o")
    assert stored.count() == landed[1].count() == stored.select("event_id").distinct().count()


def test_trade_sink_keeps_stored_and_late_trades(spark, tmp_path):
    schema = "id string, market string, ts timestamp"
    first = land(spark, f"{tmp_path}/a", schema, [("x1", "m", ts(100_000))], [("x2", "m", ts(110_000)), ("x3", "n", None)],
                 [("x4", "n", ts(99_000)), ("x1", "m", ts(100_000)), ("x3", "n", None)])
    native.start_trade_sink(first, f"{tmp_path}/o", f"{tmp_path}/c1", ["id"], available_now=True).awaitTermination()
    second = land(spark, f"{tmp_path}/b", schema, [("y1", "m", ts(5_000_000)), ("x2", "m", ts(110_000))])
    native.start_trade_sink(second, f"{tmp_path}/o", f"{tmp_path}/c2", ["id"], available_now=True).awaitTermination()
    assert [r[0] for r in rows(spark.read.parquet(f"{tmp_path}/o"), "id")] == ["x1", "x2", "x3", "x4", "y1"]


def test_buckets_keep_late_rows(spark, landed, tmp_path):
    s = stream(spark, landed).withColumn("s", F.floor(F.col("t") / 1_000_000))
    native.start_bucket_log(s, f"{tmp_path}/l", f"{tmp_path}/c", ["user_id"], ["value"], width=3600, time="s",
                            order=["t", "event_id"], available_now=True).awaitTermination()
    got = native.current_buckets(Log(spark, f"{tmp_path}/l").read(), ["user_id"], ["value"])
    assert same(got, bucket_last(landed[1], ["user_id"], "t", 3600, ["value"], seq="event_id"))


def test_catalog_log(spark, landed, tmp_path):
    log = stream(spark, landed).select("user_id", "t", "event_id", "event_type")
    native.start_catalog_log(log, f"{tmp_path}/l", f"{tmp_path}/c", available_now=True).awaitTermination()
    batches = Log(spark, f"{tmp_path}/l").manifest()["batches"]
    assert len(batches) == 4 and len({b.split("/")[0] for b in batches}) == 1
    stored = Log(spark, f"{tmp_path}/l").read()
    native.start_catalog_log(stream(spark, landed).select("user_id", "t", "event_id", "event_type"), f"{tmp_path}/l",
                             f"{tmp_path}/c2", available_now=True).awaitTermination()
    assert Log(spark, f"{tmp_path}/l").read().count() == 2 * landed[1].count()
    got = native.current_catalog(stored, ["user_id"], ["event_type"], "t", order=["t", "event_id"])
    assert same(got.select("user_id", "event_type"), latest_per_key(landed[1], ["user_id"], ["t", "event_id"], ["event_type"]))


def test_flag_halted(spark, tmp_path):
    m = spark.createDataFrame([("p", "a", 10_000, 0), ("p", "b", 10**7, 0), ("q", "c", 10_000, 0)], "platform string, market_id string, game_start_ts long, outage_affected int")
    spark.createDataFrame([("p", 10_000 + 28_800, False), ("p", 10**7, True), ("q", 10_000 + 28_801, False)], "platform string, ts long, active boolean").write.parquet(f"{tmp_path}/p")
    polls = spark.readStream.schema("platform string, ts long, active boolean").parquet(f"{tmp_path}/p")
    hits = drain(native.stream_flag_halted(polls, m, ["platform"], ["market_id"]), "t6")
    patch = hits.select("platform", "market_id").distinct().withColumn("outage_affected", F.lit(1))
    assert rows(set_fields(m, patch, ["platform", "market_id"], ["outage_affected"]), "market_id", "outage_affected") == [("a", 1), ("b", 0), ("c", 0)]


class Store:
    """A state store that counts its calls."""

    def __init__(self):
        self.values, self.calls, self.timers = {}, 0, set()

    def getValueState(self, name, schema):
        store = self

        class State:
            def exists(self):
                store.calls += 1
                return name in store.values

            def get(self):
                store.calls += 1
                return store.values[name]

            def update(self, value):
                store.calls += 1
                store.values[name] = value

            def clear(self):
                store.values.pop(name, None)

        return State()

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)

    def getCurrentWatermarkInMs(self):
        return 0


def test_calls_to_the_state_do_not_grow_with_rows_or_keys():
    schema = pa.schema([("k", pa.int64()), ("t", pa.int64()), ("v", pa.string()), ("up", pa.bool_())])
    data = pd.DataFrame({"k": np.arange(3000) % 700, "t": np.arange(3000) * 1_000_000 + 1, "v": "x", "up": np.arange(3000) % 2 == 0})
    for made in (keyed._ChangeOnly(["k"], ["t"], "v", schema), keyed._Halts(["k"], "t", "up", None, schema)):
        store = Store()
        made.init(store)
        for part in (data[:1000], data[1000:]):
            list(made.handleInputRows((0,), iter([part]), store))
        assert store.calls < 20 and len(store.timers) <= 1
