"""The batch log: bounded files, repeated batches, lost runs and merges."""

import glob
import os

from helpers import rows
from pyspark.sql import functions as F

from marketlake.sinks.log import Log


def batch(spark, i):
    return spark.createDataFrame([(k, i, f"v{i}") for k in range(i % 3, 6, 2)], "k int, at int, v string").coalesce(1)


def newest(df):
    return df.groupBy("k").agg(F.max_by("v", "at").alias("v"), F.max("at").alias("at"))


def files(path):
    return glob.glob(f"{path}/data/*/*.parquet")


def test_files_stay_few_and_rows_are_whole(spark, tmp_path):
    log = Log(spark, str(tmp_path), newest, merge_after=5)
    assert log.read() is None and log.manifest()["number"] == 0
    for i in range(30):
        assert log.append(batch(spark, i), f"run/{i}")
        assert not log.append(batch(spark, i), f"run/{i}")
        assert len(log.manifest()["folders"]) <= 6
    want = {}
    for i in range(30):
        want |= {k: i for k in range(i % 3, 6, 2)}
    assert {r["k"]: r["at"] for r in newest(log.read()).collect()} == want
    assert len(os.listdir(f"{tmp_path}/data")) <= 6 + 3 * 6 and len(glob.glob(f"{tmp_path}/manifest/[0-9]*.json")) <= 9


def test_without_a_merge_rule_all_rows_stay(spark, tmp_path):
    log = Log(spark, str(tmp_path), merge_after=3)
    for i in range(9):
        log.append(batch(spark, i), str(i))
    assert log.read().count() == sum(len(range(i % 3, 6, 2)) for i in range(9))


def test_a_lost_run_leaves_the_old_manifest_valid(spark, tmp_path):
    log = Log(spark, str(tmp_path))
    log.append(batch(spark, 0), "0")
    before = rows(log.read())
    log._write(batch(spark, 1))  # lost before its manifest
    open(f"{tmp_path}/drafts/half", "w").close()
    assert rows(Log(spark, str(tmp_path)).read()) == before
    log.append(batch(spark, 1), "1")
    log.compact()
    log.vacuum()
    assert log.read().count() == batch(spark, 0).count() + batch(spark, 1).count()
    assert len(log.manifest()["folders"]) == 1


def test_two_writers_do_not_lose_batches(spark, tmp_path):
    a, b = Log(spark, str(tmp_path)), Log(spark, str(tmp_path))
    a.append(batch(spark, 0), "a")
    now = b.manifest()
    a.append(batch(spark, 1), "b")
    assert not b._commit({**now, "number": now["number"] + 1})
    b.append(batch(spark, 2), "c")
    assert b.manifest()["batches"] == ["a", "b", "c"] and len(b.manifest()["folders"]) == 3
