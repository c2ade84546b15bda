"""Places in one global order without one global sort task: ranges, totals of ranges, running sums within ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from gaugewise.llm.common import stage


def placed(rows: DataFrame, order: list[Column], amount: Column, name: str, group: str | None = None) -> DataFrame:
    """Adds ``place``: the sum of ``amount`` over all rows before this one in ``order``, within its ``group``, and ``whole``,
    the group's sum.

    Rows are dealt into ranges of (group, order), so a group with a third of all rows is many ranges; each range sums
    its own rows and starts from the totals of the ranges before it. ``order`` should tell all rows apart, so that
    equal keys do not end in one range. ``name`` names the written stage. The group is never null."""
    keys = [F.col(group)] if group else []
    rows = stage(rows.withColumn("amount", amount).repartitionByRange(*keys, *order).withColumn(
        "range", F.spark_partition_id()), name)
    own = ["range", *([group] if group else [])]
    totals = rows.groupBy(*own).agg(F.sum("amount").alias("total"))
    every = Window.partitionBy(*([group] if group else []))
    earlier = every.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*own, F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"), F.sum("total").over(
        every).alias("whole"))
    within = Window.partitionBy(*own).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("amount").over(within), F.lit(0)))
    return rows.join(totals, own).withColumn("place", F.col("base") + F.col("within")).drop(
        "amount", "range", "base", "within")
