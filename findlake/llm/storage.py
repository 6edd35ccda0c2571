"""Shared scratch tables: lineage is cut by tables written in the folder of ``spark.checkpoint.dir``."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch of texts: what a task holds at once, on both sides of the pipe to Python.
TEXT_ROWS = 1000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Lets shuffle files go when the execution that wrote them ends, not when the driver happens to collect its garbage.
CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Taken from ``spark.checkpoint.dir``, else from the context's checkpoint directory. Where neither is set a local
    session makes and sets a temporary folder; any other is an error, as executors would write to disks of their own.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="findlake-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Let no Arrow batch of this session have more than TEXT_ROWS rows: whole texts can be long."""
    if not 0 < int(spark.conf.get(BATCH_SETTING)) <= TEXT_ROWS:
        spark.conf.set(BATCH_SETTING, str(TEXT_ROWS))


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None or sc._jvm is None:
        return
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def materialize(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table; its shuffle files go as soon as it is written."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    before = spark.conf.get(CLEANUP_SETTING, None)
    spark.conf.set(CLEANUP_SETTING, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP_SETTING)
        else:
            spark.conf.set(CLEANUP_SETTING, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` whose last reader has ended."""
    for table in tables:
        _delete(table.sparkSession, table._scratch)
