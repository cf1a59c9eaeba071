"""Running sums and row numbers over a whole table without passing it through one task.

Rows are dealt to ranges of the order; sums of ranges are added up (a few thousand rows), and each
range goes on from the sum before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize


def running_sum(rows: DataFrame, value: Column, part: Column, order: list[str], name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all rows up to this one.

    ``part`` numbers ranges of the order, in its direction; there should be some thousands of them at most.
    """
    dealt = rows.withColumn("__part", part).withColumn("__value", value)
    totals = dealt.groupBy("__part").agg(F.sum("__value").alias("__total"))
    before = totals.withColumn("__before", F.coalesce(F.sum("__total").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__total")
    within = F.sum("__value").over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("__within", within).join(F.broadcast(before), "__part").withColumn(name, F.col("__within") + F.col("__before")).drop("__part", "__value", "__within", "__before")


def hex_part(digest: Column, digits: int = 3) -> Column:
    """Ranges of a hexadecimal digest: 16 to the power of ``digits`` of about equal size."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("int")


def in_ranges(rows: DataFrame, order: list[str], parts: int | None = None, block: str = "block") -> DataFrame:
    """The rows, written, with the number of the range of ``order`` that each is in: ranges ascend and have about as many rows each.

    Split points are drawn from a sample of (order, row), so neither a skewed nor a repeated key fills
    a range; rows that are equal in ``order`` may lie in several ranges. Nulls come first. Without
    ``parts`` there are as many ranges as shuffle partitions after small ones are joined.
    """
    numbered = rows.withColumn("__row", F.monotonically_increasing_id())
    keys = [*order, "__row"]
    dealt = numbered.repartitionByRange(parts, *keys) if parts else numbered.repartitionByRange(*keys)
    return materialize(dealt.withColumn(block, F.spark_partition_id()), "ranges").withColumnRenamed("__row", f"{block}_row")


def running_total(rows: DataFrame, value: Column, order: list[str], name: str, parts: int | None = None) -> DataFrame:
    """``running_sum`` over ranges of equal numbers of rows; of rows that are equal in ``order`` one comes after the other."""
    dealt = in_ranges(rows, order, parts, "__range")
    return running_sum(dealt, value, F.col("__range"), [*order, "__range_row"], name).drop("__range", "__range_row")


def running_max(rows: DataFrame, key: str, value: str, order: list[str], name: str, parts: int | None = None) -> DataFrame:
    """Adds ``name``: of each key, the greatest ``value`` up to this row. Keys may have any share of the rows.

    Rows are dealt to ranges of the order, whatever their keys; a key's greatest value in each range goes
    on to the later ranges, which is a table of ranges and keys. A null value counts for nothing.
    """
    dealt = in_ranges(rows, order, parts, "__range")
    tops = dealt.groupBy("__range", key).agg(F.max(value).alias("__top"))
    before = tops.withColumn("__before", F.max("__top").over(Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select(F.col("__range").alias("__r"), F.col(key).alias("__k"), "__before")
    within = F.max(value).over(Window.partitionBy("__range", key).orderBy(*order, "__range_row").rowsBetween(Window.unboundedPreceding, 0))
    joined = dealt.withColumn("__within", within).join(before, (F.col("__range") == F.col("__r")) & F.col(key).eqNullSafe(F.col("__k")))
    return joined.withColumn(name, F.greatest("__within", "__before")).drop("__range", "__range_row", "__r", "__k", "__within", "__before")
