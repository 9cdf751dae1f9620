"""Session helpers: the shared folder, staged tables and key arithmetic."""

from __future__ import annotations

import atexit
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_runs: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, from ``spark.checkpoint.dir``."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in this process's own folder below the shared one, which is deleted when the process ends."""
    own = next((run for run, session in _runs.items() if session is spark and run.startswith(shared_dir(spark) + "/")), None)
    if own is None:
        own = f"{shared_dir(spark)}/cohortium-{uuid.uuid4().hex}"
        _runs[own] = spark
    return f"{own}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clear() -> None:
    for path, spark in _runs.items():
        try:
            delete(spark, path)
        except (Py4JError, OSError, AttributeError):  # the session has ended before; its folder stays
            continue


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: short lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged.staged_at = path
    return staged


def unstage(*frames: DataFrame) -> None:
    """Delete staged tables that nothing reads any more; other frames are left alone."""
    for df in frames:
        path = getattr(df, "staged_at", None)
        if path:
            delete(df.sparkSession, path)


def small_side(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """``df``, written once, and hinted for broadcast when its counted size allows it, else as it is for a plain join."""
    df = stage(df, "side")
    return F.broadcast(df) if df.count() <= max_rows else df


def bucket(key: str | Column, salt: int, buckets: int, hashed: bool = False) -> Column:
    """Bucket 0..buckets-1 that depends on the key alone, never on partitions or row order.

    The plain form is arithmetic that any SQL engine can repeat; ``hashed`` suits keys of any
    type and has no pattern.
    """
    key = F.col(key) if isinstance(key, str) else key
    if hashed:
        return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(buckets)).cast("int")
    # reduced first, so that the product cannot overflow; one multiplier per salt
    spread = (F.pmod(key, F.lit(1_000_003)) + 1) * (7919 + 104_729 * salt)
    return (spread % 999_983 % buckets).cast("int")
