"""Running sums over rows in a total order, for groups of any size.

A group (a source) may hold a third of all rows, so no task may sort a whole group. The rows are dealt by ranges of
(group, order); each range is summed on its own, and the totals of the ranges, one row for each group and range, give
the offsets. What is known of a group is joined to these totals, never to the rows by the group's key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackwise.llm.common import stored

#: Ranges for each shuffle partition: ranges are hashed to partitions again, and many small ones fall more evenly.
RANGES = 2
#: Rows that make a range worth a task, and a file.
RANGE_ROWS, FILE_ROWS = 2000, 50_000


def compact(df: DataFrame, rows: int) -> DataFrame:
    """Few rows in few files, for tables that are read again and again; larger ones stay as they are dealt."""
    return df.coalesce(1 + rows // FILE_ROWS)


def ranged(rows: DataFrame, by: list[str], order: list[str], count: int) -> DataFrame:
    """The ``count`` ``rows`` dealt by ranges of (by, order) and stored, with the range's number. Null keys are a group of
    their own and come first; rows that agree in ``by`` and ``order`` stand in any order, but keep it."""
    n = min(RANGES * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + count // RANGE_ROWS)
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(n, *by, *order, "_tie").withColumn("_range", F.spark_partition_id())
    return stored(dealt, "ranges")


def attach(dealt: DataFrame, by: list[str], groups: DataFrame) -> DataFrame:
    """Adds the columns of ``groups`` (one row a group, keyed by ``by``); groups without a row there get nulls."""
    parts = dealt.select(*by, "_range").distinct()
    return _join(dealt, _join(parts, groups, by, "left"), [*by, "_range"])


def running(dealt: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows before it in its group."""
    key = [*by, "_range"]
    totals = dealt.groupBy(*key).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("_start", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*key).orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return _join(local, starts, key).withColumn(name, F.col("_start") + F.col("_local")).drop("_start", "_local")


def place(dealt: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Adds ``name``: the number of rows before it in its group."""
    return running(dealt, by, order, F.lit(1).cast("long"), name)


def _join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join in which nulls are equal; the keys come from the left."""
    named = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(named, on, how).drop(*[f"_r_{k}" for k in keys])
