"""Lineage cuts, tables in the shared folder, and a global row number that no single task computes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or the one set on the context.

    Where neither is set, a local master gets a temporary folder as checkpoint folder; on a cluster that is an error, since
    its machines wouldn't see each other's files.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    held = context._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="kmerloom-"))
        held = context._jsc.sc().getCheckpointDir()
    return held.get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder; keeps the partitions as they are."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder. Spark then knows its size, and it is compressed."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def stored_alone(df: DataFrame) -> DataFrame:
    """As `stored`; what the query shuffled is deleted at once, where Spark can do so."""
    key, conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", df.sparkSession.conf
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return stored(df)
    finally:
        conf.set(key, before)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark knows."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def remove(*tables: DataFrame) -> None:
    """Delete tables made by `stored` that nothing reads any more."""
    for t in tables:
        remove_path(t.sparkSession, t.stored_at)


def global_rank(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """df with its row number from 0 in this order: a range partitioning, and begins from one row per partition."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = cut(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    begins = d.groupBy("_part").agg(F.count("*").alias("_n"))
    begins = begins.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_begin"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return d.withColumn("_local", local).join(F.broadcast(begins), "_part").withColumn(name, (F.col("_begin") + F.col("_local")).cast("long")).drop("_part", "_local", "_begin")


def rank_stored(df: DataFrame, order: str, name: str) -> DataFrame:
    """As `global_rank` by one column, as a table in its order: rows move once. df should be stored itself, as it is sampled first."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.repartitionByRange(n, order).sortWithinPartitions(order)
    d = stored_alone(d.withColumn("_at", F.monotonically_increasing_id()))  # the partition, and in 33 bits the row in it
    part = F.shiftright("_at", 33)
    begins = d.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    begins = begins.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_begin"))
    d = d.withColumn("_part", part).join(F.broadcast(begins), "_part")
    return d.withColumn(name, (F.col("_begin") + F.col("_at").bitwiseAND((1 << 33) - 1)).cast("long")).drop("_part", "_begin", "_at")
