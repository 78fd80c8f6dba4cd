"""Global order and numbering over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagemill.session import checkpoint, task_count


def ranged(df: DataFrame, *order: Column) -> DataFrame:
    """Rows in global order over many partitions, with the partition number in ``_pid``.

    The bounds come from a sample, so the result is written once: readers that look at it
    twice, or again after a lost executor, must see the same partitions. The partition count
    is named to keep adaptive execution from merging partitions differently per reader.
    """
    return checkpoint(df.repartitionByRange(task_count(df), *order).withColumn("_pid", F.spark_partition_id()))


def numbered(df: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """``df`` with the place of each row in its group, from 1, by order; a large group is numbered by many tasks."""
    rows = ranged(df, F.col(group), F.col(order))
    counts = rows.groupBy(group, "_pid").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = F.row_number().over(Window.partitionBy("_pid", group).orderBy(order))
    return rows.withColumn("_in", inside).join(offsets, [group, "_pid"]).withColumn(name, F.col("_off") + F.col("_in")).drop("_off", "_in", "_pid")
