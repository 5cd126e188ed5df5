"""Global places in a sorted order, whatever the partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import materialise


def placed(keys: DataFrame, order: list[Column], *, weight: str | None = None) -> DataFrame:
    """Adds ``place``, the rows (or their summed ``weight``) before a row in the order, from 0, and ``places``, all of them.

    Keys must differ in the order.  They are dealt to ranges, numbered within them and offset by the sums of the ranges
    before; where the ranges end, which Spark samples, does not show in the result.  The ordered pass is over one row a range.
    """
    ranged = materialise(keys.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    n = F.count("*") if weight is None else F.sum(weight)
    sums = ranged.groupBy(F.col("__range").alias("__of")).agg(n.alias("__n"))
    before = Window.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("__of").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = sums.select(
        "__of", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"), F.sum("__n").over(whole).alias("places")
    )
    inner = Window.partitionBy("__range").orderBy(*order)
    if weight is None:
        within = F.row_number().over(inner) - 1
    else:
        within = F.coalesce(F.sum(weight).over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = ranged.withColumn("__within", within.cast("bigint")).join(F.broadcast(offsets), F.col("__range") == F.col("__of"))
    return numbered.withColumn("place", F.col("__offset") + F.col("__within")).drop("__range", "__of", "__offset", "__within")
