"""The current state of records that arrive late and more than once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that ids are padded with.
SPACE = r"^[\s ]+|[\s ]+$"


def trimmed(column: str | Column) -> Column:
    """The text without white space at its ends; null stays null."""
    return F.regexp_replace(F.col(column) if isinstance(column, str) else column, SPACE, "")


def current_rows(df: DataFrame, key: Sequence[str], order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row for each ``key``: that with the largest ``order`` (null smallest), with the columns ``keep``.

    A maximum over one struct combines on the map side, so copies never travel and a hot key stays cheap; ties in
    ``order`` go to the larger ``keep`` values, so the result doesn't depend on the order of rows. ``keep`` must be
    sortable columns. Rows with null in ``key`` form a key of their own. An empty table gives an empty table.
    """
    best = F.max(F.struct(*order, *[k for k in keep if k not in order])).alias("_best")
    return df.groupBy(*key).agg(best).select(*key, *[F.col(f"_best.{k}").alias(k) for k in keep])
