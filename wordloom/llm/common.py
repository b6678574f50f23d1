"""Session helpers shared by the operators: durable intermediate tables and connected components."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a Python worker gets at once; texts of some thousand bytes make about a megabyte.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor sees. A temporary one stands in only where all of Spark is one process."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if sc.getCheckpointDir() is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="wordloom-"))
        named = sc.getCheckpointDir()
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def durable(df: DataFrame) -> DataFrame:
    """df as compressed Parquet in the shared folder, read from there: its lineage is cut and it outlives executors.

    Unlike checkpoint(), its last stage runs once, rows take few bytes, and neither the
    constraints nor the statistics of old plans pile up in the driver.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/wordloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of tables that nothing refers to any more.

    Twice: what Python lets go of in the first round is out of the JVM's reach only in the second.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Texts can be long: keep the batches that cross to Python small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id, modulus: int):
    """crc32 of the id as text, modulo: the fold that splits training rows from held-out ones."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


#: Cells for each wanted key and in all: the bitmaps that are broadcast take at most 32 MB.
CELLS_PER_KEY, MOST_CELLS = 16, 1 << 28


def rows_of(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of df whose key is in wanted, a durable table of that one column.

    A bitmap of the wanted keys' hash cells, of bounded size, goes to every executor first, so that of
    df's rows only the wanted ones and some false alarms are shuffled for the join.
    """
    return maybe_in(df, key, wanted).where("maybe").drop("maybe").join(wanted, key, "left_semi")


def maybe_in(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """df with `maybe`, false only where the key isn't among wanted; nothing of df is shuffled."""
    n, cells = wanted.count(), 1 << 15
    while cells < min(MOST_CELLS, CELLS_PER_KEY * n):
        cells *= 2
    cell = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(cells))
    bits = wanted.select(cell.alias("cell")).groupBy(F.expr("cell div 32768").alias("bucket")).agg(F.bitmap_construct_agg(F.expr("cell % 32768")).alias("bits"))
    marked = df.withColumn("cell", cell).join(F.broadcast(durable(bits)), F.expr("cell div 32768 = bucket"), "left")
    byte = F.conv(F.hex(F.expr("substring(bits, cast((cell % 32768) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    maybe = F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), F.expr("cell % 8")).cast("int")) != 0, F.lit(False))
    return marked.withColumn("maybe", maybe).drop("cell", "bucket", "bits")


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(a, b) links to (node, component): the smallest node that links reach.

    Alternating large-star and small-star steps. Every step is a minimum per node, which Spark
    pre-aggregates, and an equi-join on the node, whose hot keys adaptive execution splits; no
    neighbour list is ever gathered. Nulls in a or b and self-links are ignored. Nodes without
    links to others are not returned.
    """
    edges = durable(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    for _ in range(rounds):
        both = edges.select("u", "v", F.lit(True).alias("up")).unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(False).alias("up")))
        above = F.when(F.col("up"), F.col("v"))
        mixed_up = (F.max("up") & ~F.min("up")) | (F.min(above) < F.max(above))  # links both ways, or up to two nodes
        low = durable(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.coalesce(mixed_up, F.lit(False)).alias("open")))
        if low.where("open").isEmpty():
            break  # stars around their smallest nodes
        large = durable(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"))
        low = durable(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v")))
        edges = durable(small.distinct())
    else:
        raise RuntimeError(f"links did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
