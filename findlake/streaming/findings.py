"""A finding table kept up by a stream of occurrences.

Each micro-batch adds a folder of partial findings, one row a key that it saw. Occurrences that come again within the watermark's
delay, in the same batch or in a later one, are dropped by the state that Spark keeps; a batch that runs again after a failure
overwrites its own folder. ``compact`` folds old batches into one base, so that a reader has few files to add up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from findlake.operators.numbering import delete_folder

PARTIAL = "key string, sev_rank int, first_seen timestamp, last_seen timestamp, n_occurrences long"


def partial_findings(occurrences: DataFrame) -> DataFrame:
    """``key, sev_rank, first_seen, last_seen, n_occurrences`` of occurrences (ts, key, sev_rank), a row a key."""
    return occurrences.groupBy(F.col("key").cast("string").alias("key")).agg(F.max("sev_rank").cast("int").alias("sev_rank"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("n_occurrences"))


def merge_into(batch: DataFrame, table: str, batch_id: int) -> None:
    """Add a batch's partial findings under its number; nothing old is read or rewritten."""
    partial_findings(batch).write.mode("overwrite").parquet(f"{table}/parts/batch={batch_id}")


def _there(spark: SparkSession, folder: str) -> list[str]:
    """The names of the complete folders in ``folder``: those whose writer has left its mark."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    return [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory() and fs.exists(sc._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]


def _numbers(spark: SparkSession, table: str, kind: str, name: str) -> list[int]:
    return sorted(int(n.split("=")[1]) for n in _there(spark, f"{table}/{kind}") if n.startswith(f"{name}="))


def _live(spark: SparkSession, table: str) -> tuple[int, list[str]]:
    """The last batch that the newest base holds (-1: there is none), and the folders that together are the table."""
    bases = _numbers(spark, table, "bases", "upto")
    upto = bases[-1] if bases else -1
    folders = [f"{table}/bases/upto={upto}"] * bool(bases) + [f"{table}/parts/batch={n}" for n in _numbers(spark, table, "parts", "batch") if n > upto]
    return upto, folders


def current_findings(spark: SparkSession, table: str) -> DataFrame:
    """The findings of all batches so far: those of the newest base and of the batches after it."""
    _, folders = _live(spark, table)
    rows = spark.read.schema(PARTIAL).parquet(*folders) if folders else spark.createDataFrame([], PARTIAL)
    return rows.groupBy("key").agg(F.max("sev_rank").alias("sev_rank"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("n_occurrences").alias("n_occurrences"))


def compact(spark: SparkSession, table: str) -> int:
    """Fold all complete batches into a new base and delete what it replaces; returns how many folders that were.

    Readers take a base only once it is complete, and the folders it replaces go after that: a run that breaks off leaves a table that
    reads the same, and the next run takes away what is left. No batch may be written meanwhile.
    """
    upto, folders = _live(spark, table)
    batches = _numbers(spark, table, "parts", "batch")
    if len(folders) > 1:
        new = batches[-1]
        current_findings(spark, table).write.mode("overwrite").parquet(f"{table}/bases/upto={new}")
        upto = new
    old = [f"{table}/parts/batch={n}" for n in batches if n <= upto] + [f"{table}/bases/upto={n}" for n in _numbers(spark, table, "bases", "upto") if n < upto]
    for folder in old:
        delete_folder(spark, folder)
    return len(old)


def once(occurrences: DataFrame, delay: str) -> DataFrame:
    """A stream's occurrences (ts, scan_id, pos, ...), each (scan_id, pos) once however often it comes within ``delay`` of event time.

    State is kept for that long; occurrences that come later than the delay are left out.
    """
    return occurrences.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["scan_id", "pos"])


def maintain_findings(occurrences: DataFrame, table: str, checkpoint: str, delay: str = "7 days") -> StreamingQuery:
    """Run over what is there and end; start it again for more. ``occurrences``: ts, scan_id, pos, key, sev_rank."""
    writer = once(occurrences, delay).writeStream.foreachBatch(lambda batch, n: merge_into(batch, table, n))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
