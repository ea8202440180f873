"""Numbering rows in a total order without one task seeing them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackwise.session import stored


def number_rows(df: DataFrame, order: list[Column], name: str = "n") -> DataFrame:
    """``df`` with ``name``: 0, 1, … in ``order``. The rows are dealt by ranges of the order and stored, numbered inside
    their range, and offset by the ranges' totals (one row a range)."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_range", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return dealt.withColumn("_at", inside).join(starts, "_range").withColumn(name, F.col("_start") + F.col("_at")).drop("_range", "_at", "_start")
