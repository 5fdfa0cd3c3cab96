"""Session helpers: where lineage may be cut and where job tables may be written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Falls back to a temporary folder only in local mode, where driver and executors are
    one process; a cluster without the setting is an error, because a machine-local
    folder would be lost with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):  # local-cluster has executors of its own
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    created = tempfile.mkdtemp(prefix="linksift-")
    spark.sparkContext.setCheckpointDir(created)
    return created


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to a fresh table under the shared folder and go on from there.

    Survives executor loss, computes the plan once (an eager checkpoint computes it twice),
    pins the rows for every later read, and keeps column pruning and size statistics.
    """
    path = scratch_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for a job's intermediate or output table, under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/linksift/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a job's own intermediate table that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of all files below ``path``."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows; reads no more than that many plus one."""
    return df.limit(max_rows + 1).count() <= max_rows


def by_shuffle(df: DataFrame) -> DataFrame:
    """A join side that grows with the data: sorted and merged, never gathered by the driver for a broadcast.

    Spark judges a side by its compressed files, and a small file of few distinct values may unpack to many times its size.
    """
    return df.hint("merge")


def spread(df: DataFrame) -> DataFrame:
    """Give a scan of few splits enough tasks for heavy per-row work.

    Tables of normal size already have more splits than cores and pass through unchanged;
    only a small file that would run as one task is redistributed.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() * 2 <= wanted else df
