"""Row numbers and running sums within groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.session import cut


def running_sum(df: DataFrame, group: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows before it in its group by ``order``, which must be total; 0 on the first row.

    Rows are sorted by range, so a hot group spreads over many tasks; what each task holds of a group is summed, and the
    sums before it are its offset. Nulls come first in order and count as 0 in sums.
    """
    ranged = cut(df.withColumn("_value", F.coalesce(value, F.lit(0))).repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy(*group, "_part").agg(F.sum("_value").alias("_sum")).withColumn("_offset", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inner = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    keys = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*group, "_part")]
    local = ranged.withColumn("_inner", F.coalesce(F.sum("_value").over(inner), F.lit(0)))
    return local.alias("a").join(offsets.alias("b"), keys).select(*[F.col(f"a.{c}") for c in df.columns], (F.col("a._inner") + F.col("b._offset")).alias(name))


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``df`` with ``name``: 0, 1, ... within each group by ``order``, which must be total for a defined result; nulls come first."""
    return running_sum(df, group, order, F.lit(1).cast("bigint"), name)
