"""Sums over all earlier rows of a key, for keys of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written


def before(df: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """The rows with `name`: the sum of `value` over the rows of the same `by` that come earlier in `order`; 0 for the first.

    Rows are dealt out by ranges of (by, order) and written with the number of their range, so that a key of many rows lies in many ranges.
    Each range adds up its own rows and what the key's earlier ranges hold, of which there are as many as partitions. Rows that tie in
    the order come in any order; `by` and `value` must not be null.
    """
    rows = written(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "ordered")
    earlier = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_part", *by).agg(F.sum(value).alias("_sum"))
    ranges = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_sum").over(ranges), F.lit(0))).drop("_sum")
    within = rows.withColumn("_within", F.coalesce(F.sum(value).over(earlier), F.lit(0)))
    return within.join(offsets, ["_part", *by]).withColumn(name, F.col("_within") + F.col("_offset")).drop("_part", "_within", "_offset")
