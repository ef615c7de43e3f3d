"""Tables written between jobs, in the folder all executors share."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BROADCAST_MOST = "spark.sql.adaptive.autoBroadcastJoinThreshold"
BROADCAST = "64MB"
CODEC = "zstd"  # of stored tables; about a fifth smaller than Spark's default


@functools.cache
def _of_this_process() -> str:
    return tempfile.mkdtemp(prefix="swingtrace-")


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, a local session gets a folder of its own; a cluster has
    no folder that is sure to be shared, so there it is an error.
    """
    configured = spark.conf.get(_CONF, None)
    if not configured:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()  # sparkContext.setCheckpointDir
        configured = given.get() if given.isDefined() else None
    if not configured:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"set {_CONF} to a folder that the driver and all executors share")
        configured = _of_this_process()
    return configured.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@contextlib.contextmanager
def wider_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Joins inside broadcast a side whose measured size is at most BROADCAST, unless the session broadcasts nothing.

    For joins that would otherwise move wide rows of a large table once more for the sake of a few MB.
    """
    before = spark.conf.get(_BROADCAST_MOST, None)
    if not spark.conf.get("spark.sql.autoBroadcastJoinThreshold").startswith("-"):
        spark.conf.set(_BROADCAST_MOST, BROADCAST)
    try:
        yield
    finally:
        spark.conf.unset(_BROADCAST_MOST) if before is None else spark.conf.set(_BROADCAST_MOST, before)


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Each write inside deletes its shuffle files when it ends; else they lie on disk until the driver happens to collect garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once and read back: cuts the lineage and survives the loss of any executor."""
    path = new_path(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        df.write.option("compression", CODEC).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a stored table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
