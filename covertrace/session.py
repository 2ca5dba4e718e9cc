"""Session helpers: a local session for tests and benches, table access, and lineage cuts that survive executor loss."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """A local session with the settings the engine relies on (UTC, AQE, skew-join handling)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("covertrace")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", os.environ.get("COVERTRACE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset on one machine, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
    return tempfile.mkdtemp(prefix="covertrace-shared-")


def removed_at_exit(spark: SparkSession, path: str) -> None:
    """Have what is written under ``path`` removed at the session's end."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: computed once, safe from executor loss, removed at the session's end."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/covertrace-{uuid.uuid4().hex}"
    df.write.parquet(path)
    removed_at_exit(spark, path)
    out = spark.read.parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Remove what ``written`` wrote for ``tables`` before the session's end. Nothing that reads them may be run any more."""
    for df in tables:
        if df is not None:
            sc = df.sparkSession.sparkContext
            target = sc._jvm.org.apache.hadoop.fs.Path(df.written_at)
            target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within this, the shuffle files of a statement are removed as it ends, not when the driver happens to collect its garbage.

    For statements whose results are written: a DataFrame that is itself run twice makes its shuffles again.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
