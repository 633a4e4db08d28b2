import datetime as dt

from pyspark.sql import functions as F

from chartloom.operators import longitudinal


def test_gaps(spark):
    days = ["2024-01-01", "2024-01-01", "2024-02-15", "2024-03-01", "2024-07-01", None]
    df = spark.createDataFrame([("c", dt.date.fromisoformat(d) if d else None) for d in days], "k STRING, d DATE")
    assert [(r.days, r.severity) for r in longitudinal.treatment_gaps(df, ["k"], "d").orderBy("gap_start").collect()] == [(45, "minor"), (122, "significant")]


def test_trends(spark):
    df = spark.createDataFrame([("c", i, v) for i, v in enumerate([2.0, 8.0, 8.0, 1.0, 9.0])] + [("d", 1, None)], "k STRING, n INT, v DOUBLE")
    row = longitudinal.trends(df, ["k"], "n", "v").first()
    assert (row.readings, row["mean"], row.peak_at, row.low_at, row.trend) == (5, 5.6, 4, 3, "steady")


def test_windows_delays_and_rules(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    df = spark.createDataFrame([("u", at(s)) for s in (0, 30, 60, 61)], "k STRING, t TIMESTAMP")
    assert [r.in_window for r in longitudinal.calls_in_window(df, ["k"], "t", 60).orderBy("t").collect()] == [1, 2, 2, 3]
    assert [r[0] for r in spark.range(7).select(longitudinal.retry_delay(F.col("id"))).collect()] == [1, 2, 4, 8, 16, 32, 60]
    rules = [("lab", "x"), ("la", "y")]
    assert [r.to for r in longitudinal.routed(spark.createDataFrame([("Lab",), ("law",), (None,)], "t STRING"), rules, F.col("t"), "to", "z").collect()] == ["x", "y", "z"]
    assert longitudinal.latest(df, ["k"], [F.desc("t")], 2).count() == 2


def test_symptoms_and_usage(spark):
    df = spark.createDataFrame([("c", "Pain and pain", 1), ("c", "pain, nausea", 2), ("c", None, 3)], "k STRING, t STRING, d INT")
    got = {r.symptom: (r.entries, r.first_date, r.last_date) for r in longitudinal.symptom_frequency(df, ["k"], F.col("t"), "d").collect()}
    assert got == {"pain": (2, 1, 2), "nausea": (1, 2, 2)}
    calls = spark.createDataFrame([("m", dt.datetime(2024, 1, 1, 12), 5, 2.0), ("m", dt.datetime(2023, 12, 30), 7, 1.0)], "model STRING, ts TIMESTAMP, tokens INT, response_time DOUBLE")
    row = longitudinal.usage(calls, "ts", F.lit("2024-01-02 00:00:00").cast("timestamp")).first()
    assert (row.calls, row.tokens, row.mean_response_time) == (1, 5, 2.0)
