"""Events over time: gaps in treatment, trends, frequencies, use of the model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.operators.prefix import numbered
from chartloom.operators.small import if_small


def treatment_gaps(rows: DataFrame, keys: list[str], date: str, least: int = 30) -> DataFrame:
    """(keys, gap_start, gap_end, days, severity) between consecutive dates at least ``least`` days apart."""
    days = rows.select(*keys, F.col(date).alias("gap_start")).where("gap_start IS NOT NULL").distinct()
    ahead = days.withColumn("gap_end", F.lead("gap_start").over(Window.partitionBy(*keys).orderBy("gap_start")))
    n = F.datediff("gap_end", "gap_start")
    severity = F.when(n >= 180, "critical").when(n >= 90, "significant").when(n >= 60, "moderate").otherwise("minor")
    return ahead.where(n >= least).select(*keys, "gap_start", "gap_end", n.alias("days"), severity.alias("severity"))


def trends(rows: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """(keys, readings, mean, peak, peak_at, low, low_at, trend): the trend compares the mean of the later half of
    the readings with the earlier one's; of equal extremes the first counts."""
    known = rows.where(F.col(value).isNotNull()).select(*keys, at, value)
    counts = known.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.count("*").alias("_all"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    ranked = numbered(known, keys, [at, value]).join(if_small(counts), same)
    early, late = F.col("_n") <= F.ceil(F.col("_all") / 2), F.col("_n") > F.floor(F.col("_all") / 2)
    summed = ranked.groupBy(*keys).agg(
        F.count("*").alias("readings"),
        F.round(F.avg(value), 1).alias("mean"),
        F.max(value).alias("peak"),
        F.max_by(at, F.struct(F.col(value), -F.col("_n"))).alias("peak_at"),
        F.min(value).alias("low"),
        F.min_by(at, F.struct(F.col(value), F.col("_n"))).alias("low_at"),
        F.avg(F.when(early, F.col(value))).alias("_e"),
        F.avg(F.when(late, F.col(value))).alias("_l"),
    )
    return summed.withColumn("trend", F.when(F.col("_l") > F.col("_e"), "rising").when(F.col("_l") < F.col("_e"), "falling").otherwise("steady")).drop("_e", "_l")


# Symptoms that are counted.
SYMPTOMS = ("pain", "fatigue", "weakness", "numbness", "tingling", "dizziness", "headache", "nausea", "swelling", "stiffness", "depression", "anxiety", "insomnia")


def symptom_frequency(rows: DataFrame, keys: list[str], text: Column, date: str, symptoms: tuple[str, ...] = SYMPTOMS) -> DataFrame:
    """(keys, symptom, entries, first_date, last_date) of each symptom named; a text counts once a symptom."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = rows.select(*keys, F.col(date).alias("_d"), F.explode(F.array_compact(F.array(*(F.when(low.contains(s), s) for s in symptoms)))).alias("symptom"))
    return found.groupBy(*keys, "symptom").agg(F.count("*").alias("entries"), F.min("_d").alias("first_date"), F.max("_d").alias("last_date"))


def usage(calls: DataFrame, at: str, until: Column, hours: int = 24) -> DataFrame:
    """Calls, tokens and mean response time of the hours before ``until``, by model."""
    recent = calls.where((F.col(at) >= until - F.expr(f"INTERVAL {hours} HOURS")) & (F.col(at) <= until))
    return recent.groupBy("model").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.avg("response_time").alias("mean_response_time"))


def calls_in_window(calls: DataFrame, keys: list[str], at: str, seconds: int = 60) -> DataFrame:
    """Adds in_window: calls of the key in the seconds up to each call, the earliest instant left out."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    by = Window.partitionBy(*keys).orderBy("_at").rangeBetween(-seconds * 1_000_000 + 1, 0)
    return calls.withColumn("_at", micros).withColumn("in_window", F.count("*").over(by)).drop("_at")


def latest(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The last n rows of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def retry_delay(attempt: Column, base: float = 1.0, factor: float = 2.0, most: float = 60.0) -> Column:
    """Seconds before a repeated call, without jitter."""
    return F.least(F.lit(base) * F.pow(F.lit(factor), attempt), F.lit(most))


def routed(rows: DataFrame, rules: list[tuple[str, str]], text: Column, into: str, default: str) -> DataFrame:
    """Adds ``into``: the target of the first rule whose words the text holds, in upper case."""
    up = F.upper(F.coalesce(text, F.lit("")))
    found = F.lit(default)
    for words, target in reversed(rules):
        found = F.when(up.contains(words.upper()), target).otherwise(found)
    return rows.withColumn(into, found)
