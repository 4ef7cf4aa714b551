"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def build_session(master: str | None = None, app: str = "quire",
                  shuffle_partitions: int | None = None,
                  driver_memory: str | None = None) -> SparkSession:
    """A session tuned for the library: AQE on, UI off, UTC clock.

    On a cluster pass ``master=None`` and let spark-submit decide; the
    shuffle partition count then comes from the cluster configuration.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (b.config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.files.maxPartitionBytes", "64m")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory:  # only effective when this call starts the JVM (local runs)
        b = b.config("spark.driver.memory", driver_memory)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster sets it to shared storage.  Where it is unset a private folder
    serves local runs and tests only: a cluster's executors couldn't see it.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    if not conf:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="quire-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, until :func:`clear_shared`."""
    return f"{_shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def shared_table(df: DataFrame) -> DataFrame:
    """``df`` written once into the shared folder and read back: all later uses
    see the same rows, also after the loss of an executor.  The table lives
    until :func:`clear_shared`."""
    spark = df.sparkSession
    path = shared_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_shared(spark: SparkSession) -> bool:
    """Delete the tables that this application has put into the shared folder
    (call it once the results that read them are written)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_shared_root(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _shared_root(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/quire-{spark.sparkContext.applicationId}"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df``, dealt to all cores by a hash of ``keys`` where its files have fewer
    splits than the session has cores (a small file is one split, and whatever is
    computed from it would be one task).  Large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores, *keys)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
