"""Running totals that no hot group can gather in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactry.sources.tables import checkpointed


def running_total(df: DataFrame, group: list[str], order: list[Column], amount: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``amount`` from the first row of its group up to the row itself.

    The rows are sorted by range over group and order, which splits a large group;
    each partition sums its own rows, and what the partitions before hold of a
    group, one number each, is added. ``order`` must be total. A null group is a group.
    """
    rows = checkpointed(df.withColumn("__amount", amount).orderBy(*group, *order).withColumn("__p", F.spark_partition_id()))
    parts = rows.groupBy(*group, "__p").agg(F.sum("__amount").alias("__n"))
    w = Window.partitionBy(*group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select(*(F.col(g).alias(f"__g{k}") for k, g in enumerate(group)), F.col("__p").alias("__q"), F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))
    rows = rows.withColumn("__within", F.sum("__amount").over(Window.partitionBy(*group, "__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    same = reduce(lambda a, b: a & b, [rows[g].eqNullSafe(before[f"__g{k}"]) for k, g in enumerate(group)], rows["__p"] == before["__q"])
    return rows.join(before, same).withColumn(name, F.col("__before") + F.col("__within")).drop("__amount", "__p", "__within", "__before", "__q", *(f"__g{k}" for k in range(len(group))))
