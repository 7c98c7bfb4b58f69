"""Session settings and lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "codeloom", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; a cluster passes its own instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """Shared folder for staged tables: the cluster's ``spark.checkpoint.dir``.

    Only a session without that setting (a test on one machine) gets a folder
    of its own, remembered in the session so that all stages share it.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local(\[(\d+|\*)|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="codeloom-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def stage(df: DataFrame, label: str, folder: str | None = None, **options: str | None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage like a checkpoint but stays columnar, so each consumer
    reads only its columns, and a lost executor re-reads instead of recomputing.
    Its size on disk is known, so Spark itself broadcasts it in a join exactly
    when it is below the configured threshold.
    """
    spark = df.sparkSession
    path = f"{folder or work_dir(spark)}/stage-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, **options)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def staging_area(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """``stage`` into a new folder of the shared one that is gone after the block."""
    folder = f"{work_dir(spark)}/run-{uuid.uuid4().hex}"
    try:
        yield lambda df, label, **options: stage(df, label, folder, compression="zstd", **options)
    finally:
        remove(spark, folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of this run with all that is in it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session for the time of the block."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def spread(df: DataFrame) -> DataFrame:
    """Redistribute an input of few small files over the session's task slots.

    A file with one row group is one busy task however many cores there are.
    Inputs with more files or splits, which is any large table, pass unchanged.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    few = len(df.inputFiles()) < slots and df.rdd.getNumPartitions() < 2 * slots
    return df.repartition(slots) if few else df
