"""The working folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import InvalidConfiguration


def work_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A temporary one is set only where all of Spark runs on one machine."""
    sc = spark.sparkContext
    if have := sc.getCheckpointDir():
        return have
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise InvalidConfiguration("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="kinfold-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared folder."""
    work_root(df.sparkSession)
    return df.checkpoint()


def numbered(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """The rows with their place (from 1) in a total order, without putting them in one task.

    Rows are dealt by ranges and sorted there; a row's place is its place in the range after
    the rows of the ranges before, of which there are as many as partitions.
    """
    kept = cut(df.repartitionByRange(*order).sortWithinPartitions(*order))
    kept = kept.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = kept.groupBy("_part").agg(F.count("*").alias("_n"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    out = kept.join(F.broadcast(before), "_part")
    return out.withColumn(name, (F.col("_before") + F.col("_at") + 1).cast("int")).drop("_part", "_at", "_before")
