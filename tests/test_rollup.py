"""Counts kept at write time equal a scan; a database is read by as many tasks as asked."""

from helpers import rows, ts
from pyspark.sql import functions as F

from marketlake.operators.catalog import coverage, coverage_of_counts
from marketlake.sinks.append import read_series
from marketlake.sinks.rollup import Rollup, append_counted
from marketlake.sources import legacy

WEEK = 7 * 86_400


def test_counts_equal_a_scan(spark, tmp_path):
    roll = Rollup(spark, f"{tmp_path}/r", merge_after=2)
    assert roll.markets() is None
    for i in range(6):
        late = [("p", "m1", ts(5), 0.5)] if i == 5 else []
        df = spark.createDataFrame([("p", f"m{k}", ts(i * WEEK + k), 0.1) for k in range(i)] + late + [("q", "n", ts(i), 0.3)],
                                   "platform string, market_id string, ts timestamp, price double")
        assert append_counted(df, f"{tmp_path}/s", roll, f"b{i}") and not append_counted(df, f"{tmp_path}/s", roll, f"b{i}")
    series = read_series(spark, f"{tmp_path}/s")
    markets = spark.createDataFrame([("p", f"m{k}", f"e{k % 2}") for k in range(7)] + [("q", "n", None)], "platform string, market_id string, event_id string")
    assert rows(coverage_of_counts(markets, {"trades": roll.markets()})) == rows(coverage(markets, {"trades": series}))
    assert rows(roll.markets(), "market_id", "n", "first_ts", "last_ts") == rows(
        series.groupBy("market_id").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")))
    assert roll.weeks().count() == series.select("platform", "market_id", F.date_trunc("week", "ts")).distinct().count()
    plan = coverage_of_counts(markets, {"trades": roll.markets()})._jdf.queryExecution().executedPlan().toString()
    assert f"{tmp_path}/s" not in plan


def test_a_database_is_read_in_parts(spark):
    url = "jdbc:derby:memory:legacy;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    connection = spark.sparkContext._jvm.java.sql.DriverManager.getConnection(url)
    statement = connection.createStatement()
    statement.execute("create table candles (market_id varchar(60), ts bigint)")
    for i in range(50):
        statement.execute(f"insert into candles values ('{'m' * (i + 1)}', {i})")
    statement.execute("insert into candles values (null, 50)")
    got = legacy._read_parts(spark, "candles", 4, "mod(length({key}), {n})", {"url": url, **driver})
    assert got.rdd.getNumPartitions() == 4
    assert sorted(r["TS"] for r in got.collect()) == list(range(51))
    sizes = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 25
