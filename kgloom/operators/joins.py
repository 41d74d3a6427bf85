"""Joins that Spark has no plan of its own for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of_join(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, take: Sequence[str], tie: str | None = None) -> DataFrame:
    """Every row of ``left`` with the columns ``take`` of the last row of ``right`` with the same ``by`` whose ``at`` is no later; nulls if there is none.

    One sort of both sides together; of right rows at the same moment the largest ``take`` counts. No pairs are made.
    """
    rest = [c for c in left.columns if c not in (*by, at)]
    a = left.select(*by, at, F.lit(1).alias("_side"), F.struct(*rest).alias("_row"), F.lit(None).cast(right.select(F.struct(*take).alias("s")).schema["s"].dataType).alias("_take"))
    b = right.select(*by, at, F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.struct(*take).alias("_take"))
    order = Window.partitionBy(*by).orderBy(at, "_side", F.col("_take")).rowsBetween(Window.unboundedPreceding, 0)
    seen = a.unionByName(b).withColumn("_last", F.last("_take", ignorenulls=True).over(order))
    return seen.where("_side = 1").select(*by, at, *[F.col(f"_row.{c}").alias(c) for c in rest], *[F.col(f"_last.{c}").alias(c) for c in take])


def interval_join(points: DataFrame, ranges: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Points joined with the ranges [low, high) that hold their ``value``.

    Both sides are put into bins of ``width`` and joined on these; a range goes to every bin it touches, so ``width``
    should be near the usual length of a range.
    """
    bin_of = lambda c: F.floor(F.col(c) / width).cast("bigint")
    spread = ranges.withColumn("_bin", F.explode(F.sequence(bin_of(low), bin_of(high))))
    return points.withColumn("_bin", bin_of(value)).join(spread, "_bin").where((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("_bin")
