"""Session settings for local runs and the shared folder for cut lineage."""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, name: str = "parcelcheck") -> SparkSession:
    """Session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and staged tables.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, as
    in tests, it is a folder in the session's warehouse.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    own = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_staged")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def staging_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, removed when the session ends."""
    made = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    path, system = _at(spark, made)
    system.deleteOnExit(path)
    return made


def remove_staged(spark: SparkSession, made: str) -> None:
    """Delete a staged table that nothing reads any more."""
    path, system = _at(spark, made)
    system.delete(path, True)


def _at(spark: SparkSession, made: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(made)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


@contextmanager
def drop_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within, shuffle files go when the action that wrote them ends.

    Without it they stay until the driver's garbage collector finds them
    unused, so that the steps of a query pile up on disk.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` as parquet to the shared folder and read it back.

    Unlike a checkpoint this keeps column pruning and filter pushdown, and a
    lost executor never has to redo the work before it.
    """
    path = staging_path(df.sparkSession, label)
    with drop_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that one task of the shape queries gets, at most about.
TASK_ROWS = 250_000


def spread(df: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Use all cores when the input has few splits, and keep tasks small when it is large.

    Fewer splits than the session has slots, or than there are ``task_rows``
    in the table, are dealt out again. The rows are counted for that, which
    reads no column of a plain table.
    """
    splits = df.rdd.getNumPartitions()
    slots = df.sparkSession.sparkContext.defaultParallelism
    wanted = max(slots, math.ceil(df.count() / task_rows))
    return df if splits >= wanted else df.repartition(wanted)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written data."""
    spark = df.sparkSession
    spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
