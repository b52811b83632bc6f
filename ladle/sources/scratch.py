"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's own checkpoint folder.

    Where neither is set, a temporary folder serves, but only in local mode (tests), where the
    driver is the only machine; a cluster must name its shared folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ladle-"))
    return spark.sparkContext.getCheckpointDir()


_cleaned: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, under one that is deleted when the driver ends."""
    base = f"{shared_dir(spark)}/ladle-{spark.sparkContext.applicationId}"
    if base not in _cleaned:
        _cleaned.add(base)
        atexit.register(_delete, spark, base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is None:  # the session has ended before the driver; the folder stays
        return
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, codec: str | None = None) -> DataFrame:
    """df as a Parquet table there: cuts lineage and survives lost executors. codec: of Parquet, the session's if not given.

    Spark removes the shuffle files of the write at its end, as nothing reads them any more.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


_FACTOR = "spark.sql.sources.fileCompressionFactor"


@contextmanager
def unpacked_sizes(spark: SparkSession, factor: int = 10) -> Iterator[None]:
    """While this lasts, Spark takes a file's rows for so many times as large as the file.

    It takes them for as large as the file else, and so would broadcast tables that are many times
    as large in memory as compressed, several at a time, each of which the driver has to hold.
    """
    before = spark.conf.get(_FACTOR)
    spark.conf.set(_FACTOR, str(factor))
    try:
        yield
    finally:
        spark.conf.set(_FACTOR, before)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `written` gave; what was made of them must be written itself by now."""
    for df in tables:
        files = df.inputFiles()
        if files:
            _delete(df.sparkSession, files[0].rsplit("/", 1)[0])
