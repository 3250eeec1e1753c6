"""Session set-up and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "pairloom", **conf) -> SparkSession:
    """Session with the settings every plan here expects.

    Shuffle partitions are left to AQE coalescing on a cluster; pass
    ``spark.sql.shuffle.partitions`` through ``conf`` for a small local run.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors reach, as the cluster names it.

    ``spark.checkpoint.dir`` wins. Only a local session without it gets a
    temporary folder; a cluster without it is an error, because a folder of one
    machine does not survive the loss of that machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder")
    current = context.getCheckpointDir()
    if current is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="pairloom-"))
        current = context.getCheckpointDir()
    return current.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several branches read one costly intermediate, or where a value
    (a partition number) must not change between two evaluations. Parquet keeps
    column pruning for the readers, and a lost executor costs one re-read. Zstandard
    takes a third less disk for texts than the default codec, and half for sets of hashes.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def read_or_default(
    spark: SparkSession, read: Callable[[], DataFrame], schema: str, rows: list[tuple] | None = None
) -> DataFrame:
    """What ``read`` gives, or ``rows`` (none unless given) where its path does not exist.

    Every other fault of reading raises.
    """
    try:
        return read()
    except AnalysisException as fault:
        if fault.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame(rows or [], schema)


def spread(df: DataFrame) -> DataFrame:
    """Repartition a scan only if it yields fewer tasks than there are cores.

    A large input has more splits than cores and passes through unchanged; a
    single small file would otherwise keep all text work in one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)
