"""Session helpers: materialisation that survives executor loss and size checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# A panel of this many (date, asset) cells is 32 MB of doubles; larger panels
# take the join path instead of travelling inside the plan.
MAX_INLINE_CELLS = 4_000_000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; one of our own only in local mode."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not shared:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before running on a cluster")
        shared = tempfile.mkdtemp(prefix="spark-riskloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def new_path(spark: SparkSession, label: str = "table") -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/riskloom/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def materialise(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a small result of a large scan is consumed several times (the
    price panel) or where lineage must be cut (iterations, fixed row order).
    Lost executors cost a re-read, not a re-scan, and the file size gives later
    joins a measured bound for choosing a broadcast.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Partition by ``columns`` into the session's full task count.

    For rows that are few in bytes but costly to process, which adaptive
    coalescing would otherwise pack into one task.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *columns)
