"""Intermediate tables: written once into the folder that every executor sees, and read from there."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a small table that may be broadcast; its size is counted before.
BROADCAST_ROWS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. A temporary one stands in only where all of Spark is one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="wordloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def place(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """df as Parquet in the shared folder: its lineage is cut, it outlives executors and is computed once."""
    path = place(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of finished queries: it does so once nothing refers to them any more."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def discard(read: DataFrame) -> None:
    """Removes the durable tables that `read` is made of, once nothing reads them any more."""
    spark = read.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in read.inputFiles()}:
        if folder.rsplit("/", 1)[-1].startswith("table-"):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, a durable table, marked for broadcast if it has few rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
