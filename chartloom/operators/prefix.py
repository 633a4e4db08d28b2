"""Running totals and positions over groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartloom.session import cut

#: Column of the slices that ``sliced`` makes.
SLICE = "_slice"


def sliced(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds ``_slice``, which grows with the order within each key: slices hold about equally many rows, by a range
    partitioning on keys and order, so a key with a third of all rows is in a third of the slices.

    Written to the shared folder, since bounds drawn again for a lost task might differ.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *keys, *order).withColumn(SLICE, F.spark_partition_id()))


def running(df: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[str, str]], inclusive: bool = True) -> DataFrame:
    """Adds the running value, up to each row and with it if ``inclusive``, of each new name: (sum, min or max; column).

    ``df`` comes from ``sliced`` by the same keys and order; rows may have been left out since. A plain window
    would sort a whole key in one task. Here a slice of a key is summed on its own and starts from what
    the slices before it came to. Only keys that reach into several slices have such starts, no more than there
    are slices, so these are broadcast. ``order`` has to be unique within a key where places matter.
    """
    agg = {"sum": F.sum, "min": F.min, "max": F.max}
    both = {"sum": lambda a, b: a + b, "min": F.least, "max": F.greatest}
    local = Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, SLICE).agg(*(agg[f](c).alias(f"_t_{new}") for new, (f, c) in values.items()))
    starts = totals.select(
        *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(SLICE).alias("_s"), F.count("*").over(before).alias("_earlier"),
        *(agg[f](f"_t_{new}").over(before).alias(f"_b_{new}") for new, (f, _) in values.items()),
    ).where("_earlier > 0")
    same = F.col(SLICE) == F.col("_s")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    summed = df.withColumns({new: agg[f](c).over(local) for new, (f, c) in values.items()}).join(F.broadcast(starts), same, "left")
    joined = summed.withColumns({new: F.coalesce(both[f](F.col(new), F.col(f"_b_{new}")), F.col(new), F.col(f"_b_{new}")) for new, (f, _) in values.items()})
    return joined.drop("_s", "_earlier", *(f"_k{i}" for i in range(len(keys))), *(f"_b_{new}" for new in values))


def numbered(df: DataFrame, keys: list[str], order: list[str], into: str = "_n") -> DataFrame:
    """Adds the place of each row within its key, from 1."""
    return running(sliced(df.withColumn("_one", F.lit(1).cast("long")), keys, order), keys, order, {into: ("sum", "_one")}).drop("_one", SLICE)
