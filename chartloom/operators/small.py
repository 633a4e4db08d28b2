"""Sides of a join that may be sent to every executor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows of a table that is broadcast.
SMALL_ROWS = 20_000


def if_small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """Marks a narrow table for broadcast where a count shows at most ``rows`` rows; else leaves the join to the optimizer."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def without_repeats(rows: DataFrame, key: str) -> DataFrame:
    """One row of each key (of null too). Rows whose key occurs once, as nearly all do, aren't shuffled where the keys that
    repeat are few; the others are."""
    again = if_small(rows.groupBy(F.col(key).alias("_again")).count().where("count > 1").select("_again"), 1_000_000)
    same = F.col(key).eqNullSafe(F.col("_again"))
    return rows.join(again, same, "left_anti").unionByName(rows.join(again, same, "left_semi").dropDuplicates([key]))
