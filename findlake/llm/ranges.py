"""Running totals in groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findlake.llm.storage import discard, materialize


def running_totals(df: DataFrame, group: Sequence[str], order: Sequence[str], amount: Column, before: str, total: str) -> DataFrame:
    """``df`` with ``before``: the sum of ``amount`` over the group's earlier rows, and ``total``: that over the whole group (longs).

    Rows are dealt out in ranges of group and order (nulls first), so that a group with a third of all rows lies in many tasks. A
    row's total is that of its range so far and that of the group's earlier ranges, of which there are no more than tasks. Rows
    that are equal in group and order come in any order. ``df`` and the ranges are written once: their borders come from a sample.
    """
    slim = materialize(df.withColumn("__amount", amount.cast("long")), "totals")
    ranged = materialize(slim.repartitionByRange(*group, *order).withColumn("__task", F.spark_partition_id()), "ranges")
    discard(slim)
    of_task = ranged.groupBy(*group, "__task").agg(F.sum("__amount").alias("__sum"))
    of_group = Window.partitionBy(*group)
    earlier = F.coalesce(F.sum("__sum").over(of_group.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    names = {c: f"__group_{i}" for i, c in enumerate(group)}
    bases = of_task.select(*[F.col(c).alias(n) for c, n in names.items()], F.col("__task").alias("__range"), earlier.alias("__base"), F.sum("__sum").over(of_group).alias(total))
    inside = Window.partitionBy(*group, "__task").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("__inside", F.coalesce(F.sum("__amount").over(inside), F.lit(0)))
    same = F.col("__task") == F.col("__range")
    for c, n in names.items():
        same = same & F.col(c).eqNullSafe(F.col(n))
    return placed.join(bases, same).select(*df.columns, (F.col("__inside") + F.col("__base")).alias(before), total)
