"""Row numbers within groups of any size."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a new one for a local session without it."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        folder = tempfile.mkdtemp(prefix="findlake-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder of any store that Spark writes to; nothing happens once the session has ended."""
    context = spark.sparkContext
    if context._jsc is not None and context._jvm is not None:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def folder_exists(spark: SparkSession, folder: str) -> bool:
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(context._jsc.hadoopConfiguration()).exists(path)


def scratch_folder(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    folder = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    atexit.register(delete_folder, spark, folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read from there; a checkpoint computes its last step twice."""
    folder = scratch_folder(df.sparkSession, tag)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], out: str, amount: str | None = None) -> DataFrame:
    """``df`` with ``out``: the row's number from 1 in its group, nulls first, as a long; with ``amount`` that column's sum up to the row.

    Rows are cut into ranges by group and order, so that a group of any size lies in many tasks; a row's number is its place in its range
    after the rows of the group's earlier ranges, which are counted before they are shuffled. Ranges are written down once, since
    their borders come from a sample. Rows that are equal in group and order are numbered by chance, as by a window.
    """
    group = list(group)
    ranges = settle(df.repartitionByRange(*group, *order).withColumn("__range", F.spark_partition_id()))
    counts = ranges.groupBy(*group, "__range").agg((F.count("*") if amount is None else F.sum(amount)).alias("__n"))
    # one row a group and range, of which a group has no more than there are tasks
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(group)], F.col("__range").alias("__r"), before.alias("__before"))
    inside = Window.partitionBy(*group, "__range").orderBy(*order)
    place = ranges.withColumn("__k", F.row_number().over(inside) if amount is None else F.sum(amount).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    same = F.col("__range") == F.col("__r")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    return place.join(offsets, same).select(*df.columns, (F.col("__k") + F.col("__before")).cast("long").alias(out))
