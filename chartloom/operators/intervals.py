"""Continuous periods and gaps of inclusive integer ranges, by a sweep line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.operators.prefix import SLICE, running, sliced


def sweep(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, kind, start, end) of the periods and gaps of each key, under the names passed in.

    Each range becomes a plus event at its start and a minus event after its end. Events of one
    position are summed before the shuffle, so that a key has one row a distinct boundary, however
    many ranges it holds; the running total of the sums counts the active ranges. The count leaves 0
    where a period starts and returns to 0 where it ends, so the n-th start and the n-th end bound
    period n, and end n and start n + 1 bound gap n.

    Ranges that touch (one ends at 9, the next starts at 10) are continuous. Rows with a null or
    reversed bound don't count. Repeated rows change nothing. A null key is a key of its own. An empty
    table gives no rows. Other columns of any name are ignored.
    """
    ranges = df.select(
        F.col(f"`{key}`").alias("_key"), F.col(f"`{start}`").cast("long").alias("_start"), F.col(f"`{end}`").cast("long").alias("_end")
    ).where("_start <= _end")
    events = (
        ranges.select("_key", F.explode(F.array(F.struct(F.col("_start").alias("_at"), F.lit(1).alias("_step")), F.struct((F.col("_end") + 1).alias("_at"), F.lit(-1).alias("_step")))).alias("_event"))
        .select("_key", "_event._at", "_event._step")
        .groupBy("_key", "_at")
        .agg(F.sum("_step").alias("_step"))
        .where("_step <> 0")
    )
    active = running(sliced(events, ["_key"], ["_at"]), ["_key"], ["_at"], {"_active": ("sum", "_step")})
    turns = active.where("_active = 0 OR _active = _step").select("_key", "_at", SLICE, (F.col("_active") > 0).cast("long").alias("_opens"))
    numbered = running(turns, ["_key"], ["_at"], {"_number": ("sum", "_opens")})
    # The n-th start opens period n and closes gap n - 1; the n-th end closes period n and opens gap n.
    opens = F.col("_opens") == 1
    part = lambda kind, number, at, is_start: F.struct(F.lit(kind).alias("kind"), number.alias("n"), F.when(is_start, at).alias("a"), F.when(~is_start, at).alias("b"))
    parts = numbered.select(
        "_key",
        F.explode(
            F.array(
                part("period", F.col("_number"), F.when(opens, F.col("_at")).otherwise(F.col("_at") - 1), opens),
                part("gap", F.when(opens, F.col("_number") - 1).otherwise(F.col("_number")), F.when(opens, F.col("_at") - 1).otherwise(F.col("_at")), ~opens),
            )
        ).alias("p"),
    )
    kind = df.schema[start].dataType
    return (
        parts.groupBy("_key", F.col("p.kind").alias("kind"), F.col("p.n").alias("_n"))
        .agg(F.max("p.a").alias("_a"), F.max("p.b").alias("_b"))
        .where("_a IS NOT NULL AND _b IS NOT NULL")
        .select(F.col("_key").alias(key), "kind", F.col("_a").cast(kind).alias(start), F.col("_b").cast(kind).alias(end))
    )
