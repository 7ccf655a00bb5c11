"""Session set-up, table loading and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "foliospark", cores: str | int | None = None) -> SparkSession:
    """Session for local tests and benchmarks; on a cluster the submitted session is used as it is."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if cores is not None:
        builder = (
            builder.master(f"local[{cores}]")
            .config("spark.sql.shuffle.partitions", str(cores))
            .config("spark.driver.memory", os.environ.get("FOLIOSPARK_DRIVER_MEMORY", "12g"))
        )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread_scan(df: DataFrame, key: str) -> DataFrame:
    """Spread a scan of fewer tasks than cores over all cores, by its unique key, before costly text work.

    A small table in one row group is read by one task. Only a local session does this, where all rows stay in one
    process; on a cluster a table is read in its splits (``spark.sql.files.maxPartitionBytes``) and not shuffled for it.
    """
    context = df.sparkSession.sparkContext
    cores = context.defaultParallelism
    return df.repartition(cores, key) if context.master.startswith("local[") and df.rdd.getNumPartitions() < cores else df


_OWN_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster in ``spark.checkpoint.dir``.

    Only where the setting is absent (local tests) a folder of our own is created, once for each application.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _OWN_FOLDERS:
        _OWN_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _OWN_FOLDERS[context.applicationId]


def durable(df: DataFrame) -> DataFrame:
    """The same rows cut from their lineage by a checkpoint in the shared folder, so that lost executors cost no recomputation."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path of its own for one run, below the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a folder that a run made by ``fresh_path`` and needs no more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Writes in here give back the disk of their shuffles as soon as their rows are stored (from Spark 4.1 on).

    Otherwise the files stay until the driver happens to collect its garbage, beside all that is written later.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
