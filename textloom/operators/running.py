"""Running totals over a whole table, without one task that orders it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, order: list[str | Column], value: str | None, name: str, before: bool = False) -> DataFrame:
    """Adds the sum of `value` (of rows, if null) over all rows up to this one in `order`, or `before` it.

    Rows are cut into ranges by sampled bounds; each range is summed and ordered by itself, and only a row a range is summed
    over all. The order must tell rows apart; nulls come first.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = F.col(value) if value else F.lit(1)
    ranged = df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id())
    sums = ranged.groupBy("_range").agg(F.sum(one).alias("_sum"))
    until = sums.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_until"))  # n rows
    w = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    total = F.col("_until") + F.coalesce(F.sum(one).over(w), F.lit(0))
    return ranged.join(F.broadcast(until), "_range").withColumn(name, total).drop("_range", "_until")
