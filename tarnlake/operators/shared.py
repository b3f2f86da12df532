"""Tables in between, kept where every executor and the driver can read them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary one on one machine; an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tarnlake-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found


def saved(df: DataFrame, width: int | None = None) -> DataFrame:
    """`df` written as Parquet in the shared folder and read again: cuts lineage, and outlives lost executors. `width`:
    tasks at most, for tables known to be small."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tarnlake-{uuid.uuid4().hex}"
    (df.coalesce(width) if width else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out = out.coalesce(width) if width else out
    out._tarnlake_path = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Deletes what saved() wrote for tables that are no longer read."""
    for df in tables:
        path = getattr(df, "_tarnlake_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
            df._tarnlake_path = None


def spread(df: DataFrame) -> DataFrame:
    """A small table that would be read by fewer tasks than there are cores, dealt over all; any other as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores and df.rdd.getNumPartitions() < cores else df
