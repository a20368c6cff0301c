"""Sampling and dense numbering in a stated order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.session import cut


def numbered(df: DataFrame, order: str, name: str = "idx") -> DataFrame:
    """Dense numbers from 0 in ``order``.

    Rows are dealt by range; counts per range give each its first number, so
    no task sees all rows.
    """
    spread = cut(df.repartitionByRange(order).withColumn("__part", F.spark_partition_id()))
    counts = spread.groupBy("__part").agg(F.count("*").alias("n"))
    firsts = counts.withColumn("first", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1
    out = spread.withColumn("__in", inside).join(F.broadcast(firsts.select("__part", "first")), "__part")  # a row per range
    return out.withColumn(name, F.col("first") + F.col("__in")).drop("__part", "__in", "first")


def strided(df: DataFrame, order: str, n: int) -> DataFrame:
    """``n`` rows evenly spaced in ``order``: every k-th, k = max(1, rows // n)."""
    step = max(1, df.count() // n)
    return numbered(df, order, "__idx").where(F.col("__idx") % step == 0).orderBy("__idx").limit(n).drop("__idx")


def chunked(df: DataFrame, order: str, chunks: int) -> DataFrame:
    """``df`` with ``chunk``: near-equal runs in ``order``, the larger first."""
    total = df.count()
    size, more = divmod(total, chunks)
    i = F.col("__idx")
    late = more + F.floor((i - more * (size + 1)) / max(size, 1))
    return numbered(df, order, "__idx").withColumn("chunk", F.when(i < more * (size + 1), F.floor(i / (size + 1))).otherwise(late).cast("int")).drop("__idx")
