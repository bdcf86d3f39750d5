"""Cutting long lineages through the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where it is unset.

    Without that setting the job is a local run or a test: a cluster must name a
    folder all executors reach.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="rinseframe-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows as a Parquet table in the shared folder and go on from there.

    Later passes read only the columns they need, know the size of the table, and
    survive the loss of executors.
    """
    path = new_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def stored(df: DataFrame) -> DataFrame:
    """``cut_lineage`` that also frees the shuffle files behind the rows, so that a chain of steps holds one step's shuffles."""
    spark, before = df.sparkSession, df.sparkSession.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        path = new_path(spark, "cut")
        df.write.parquet(path)
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def remove_stored(*tables: DataFrame) -> None:
    """Delete the files of ``stored`` tables that nothing reads any more."""
    for table in tables:
        there = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._stored_at)
        there.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(there, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered_in_order(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """Add a number from 0 without gaps in the order of some columns, with no task that holds all rows.

    Rows are sorted over ranges and stored; the ranges' row counts tell where each one's numbers begin.
    """
    ranges = df.repartitionByRange(shuffle_partitions(df.sparkSession), *by).sortWithinPartitions(*by)
    part, at = f"{name}_part", f"{name}_at"
    stored = cut_lineage(ranges.withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id()))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = stored.groupBy(part).agg(F.count(F.lit(1)).alias("n"))  # a row for each range
    begins = counts.select(F.col(part).alias("begin_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    joined = stored.join(F.broadcast(begins), F.col(part) == F.col("begin_part"))
    number = F.col("begin") + F.col(at).bitwiseAND((1 << 33) - 1)
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], number.alias(name))
