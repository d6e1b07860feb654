"""Running totals over a whole table or over very large groups, without a one-task window.

The rows are spread over contiguous ranges of the order. Each range adds up on its own; the totals of
the ranges (one small row per range and group) then shift the per-row sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayweft.session import materialise, shuffle_width


def running_total(
    df: DataFrame, value: str, order: list[str], group: list[str] | None = None, out: str = "total",
    ranges: int | None = None,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` from the first row of the group up to this one.

    ``group + order`` must identify a row. The range assignment is kept before it is used twice,
    because range bounds come from a sample and may differ between two evaluations.
    """
    group = group or []
    n = ranges or shuffle_width(df.sparkSession)
    keys = [*group, *order]
    placed = materialise(
        df.repartitionByRange(n, *keys).withColumn("_range", F.spark_partition_id())
    )
    sums = placed.groupBy("_range", *group).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.select(
        "_range", *group, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_shift")
    )
    inside = Window.partitionBy("_range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumn("_local", F.sum(value).over(inside))
    return local.join(shift, ["_range", *group]).withColumn(out, F.col("_local") + F.col("_shift")).drop(
        "_range", "_local", "_shift"
    )


def nearest_before(
    marks: DataFrame, points: DataFrame, key: str, order: list[str], value: str, out: str = "nearest", ranges: int | None = None
) -> DataFrame:
    """Add ``out`` to ``points``: the ``value`` of the last mark of the same key at or before the point.

    As ``running_total``, it works on ranges of (key, order) and carries the last mark of each range
    over to the later ones, so a key with very many rows is shared by many tasks.
    """
    spark = points.sparkSession
    n = ranges or shuffle_width(spark)
    both = marks.select(key, *order, F.lit(0).alias("_point"), F.struct(F.col(value).alias("v")).alias("_mark")).unionByName(
        points.withColumn("_point", F.lit(1)), allowMissingColumns=True
    )
    placed = materialise(both.repartitionByRange(n, key, *order).withColumn("_range", F.spark_partition_id()))
    last_in = placed.filter("_mark IS NOT NULL").groupBy("_range", key).agg(
        F.max_by("_mark", F.struct(*order)).alias("_last")
    )
    present = placed.select("_range", key).distinct().join(last_in, ["_range", key], "left")
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carry = present.select("_range", key, F.last("_last", True).over(before).alias("_carry"))
    inside = Window.partitionBy("_range", key).orderBy(*order, "_point").rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumn("_here", F.last("_mark", True).over(inside)).filter("_point = 1")
    return local.join(carry, ["_range", key]).select(
        *points.columns, F.coalesce("_here", "_carry")["v"].alias(out)
    )
