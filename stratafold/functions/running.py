"""Running sums, positions and differences that no task has to hold a whole group for.

``within`` is a column that never falls along the order, such as a range of ids, a day or the
first letters of a name. Rows are summed in their range, the ranges' sums run over their group,
and rows run in their range: a group of a third of all rows is spread over its ranges, and what
one task runs over a group is one row a range. Without keys the whole table is the group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _with_ranges(rows: DataFrame, ranges: DataFrame, on: Sequence[str]) -> DataFrame:
    """rows with their range's columns; null keys meet null keys."""
    keyed = ranges.withColumnsRenamed({c: f"_r_{c}" for c in on})
    return rows.join(keyed, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])).drop(*[f"_r_{c}" for c in on])


def running_before(df: DataFrame, value: Column, keys: Sequence[str], order: Sequence[str], within: Column, name: str) -> DataFrame:
    """df with ``name``: the sum of ``value`` over the rows of the same keys before a row; 0 for the first."""
    on = [*keys, "_range"]
    x = df.withColumn("_range", within).withColumn("_value", value)
    starts = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = x.groupBy(*on).agg(F.sum("_value").alias("_sum"))
    ranges = ranges.select(*on, F.coalesce(F.sum("_sum").over(starts), F.lit(0)).alias("_start"))
    inner = Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    x = _with_ranges(x.withColumn(name, F.coalesce(F.sum("_value").over(inner), F.lit(0))), ranges, on)
    return x.withColumn(name, F.col(name) + F.col("_start")).drop("_range", "_value", "_start")


def value_before(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], within: Column, name: str) -> DataFrame:
    """df with ``name``: the value of the row before among the same keys; null for the first."""
    on = [*keys, "_range"]
    x = df.withColumn("_range", within)
    ranges = x.groupBy(*on).agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_last"))
    ranges = ranges.select(*on, F.lag("_last").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_range"))["v"].alias("_carried"))
    inner = Window.partitionBy(*on).orderBy(*order)
    x = x.withColumn("_first", F.row_number().over(inner) == 1).withColumn(name, F.lag(value).over(inner))
    x = _with_ranges(x, ranges, on)
    return x.withColumn(name, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col(name))).drop("_range", "_first", "_carried")
