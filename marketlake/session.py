"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Runtime settings the operators rely on. AQE picks join strategies from real
#: sizes and splits skewed join partitions; timestamps are read as UTC.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Partitions are cut small and joined again by their real sizes, so that a task's share does
    # not grow with the input; shuffled bytes are compressed, in memory they are 20 times as many.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "12m",
    "spark.sql.files.maxPartitionBytes": "32m",
    # The JVM does not compile larger methods; such stages then run as smaller ones.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

STREAM_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", shuffle_partitions: int = 8, app: str = "marketlake") -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.ui.enabled", "false")
               .config("spark.driver.memory", os.environ.get("MARKETLAKE_DRIVER_MEMORY", "8g"))
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for key, value in {**RUNTIME_CONF, **STREAM_CONF}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder from ``spark.checkpoint.dir``.

    Where the session names none, a single machine uses a folder of this application in
    its temporary directory; a cluster has no such folder, so there it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{tempfile.gettempdir()}/spark-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path of this application below the shared folder."""
    return f"{shared_dir(spark)}/marketlake/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application wrote below the shared folder, once its results are read."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/marketlake/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    For results used several times: they are computed once and outlive lost executors.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A runtime setting that holds for what is run inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def small_batches(spark: SparkSession, most: int):
    """Of what is written inside, Python gets about ``most`` bytes of rows at a time (one larger row stays whole)."""
    return setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def shuffles_dropped(spark: SparkSession):
    """Shuffle files of what is written inside go when its write ends, not when the driver happens to collect its garbage."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def discard(df: DataFrame) -> None:
    """Delete a table of ``materialize`` whose last reader has been written itself."""
    spark = df.sparkSession
    own = f"{shared_dir(spark)}/marketlake/{spark.sparkContext.applicationId}/"
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        # Only whole tables of this application below the shared folder.
        if own.split(":", 1)[-1].lstrip("/") in folder:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
