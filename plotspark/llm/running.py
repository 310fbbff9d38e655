"""Running totals over groups of any size: no group, however large, is summed by one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running_total(df: DataFrame, group: list[str], weight: Column, order: str, buckets: int | Column, name: str) -> DataFrame:
    """``df`` with ``name``, the sum of ``weight`` over the rows of the group that come before.

    ``order`` is a column of different numbers; its digest deals each group's rows over ``buckets`` parts (a number, or a column that is one number in a group), which are summed first, so a
    window holds a group's part and the windows over the parts hold ``buckets`` numbers. The order is by part, then by ``order``.
    """
    many = buckets if isinstance(buckets, Column) else F.lit(buckets)
    rows = df.withColumns({"__part": F.pmod(F.xxhash64(order), many).cast("int"), "__weight": weight.cast("bigint")})
    sums = rows.groupBy(*group, "__part").agg(F.sum("__weight").alias("__sum"))
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*group, "__part", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__start"))
    within = Window.partitionBy(*group, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(starts, [*group, "__part"])
    return joined.withColumn(name, F.col("__start") + F.coalesce(F.sum("__weight").over(within), F.lit(0))).drop("__part", "__weight", "__start")
