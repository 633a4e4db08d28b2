from pyspark.sql import functions as F

from chartloom.operators import routing
from chartloom.plans import report

MAPPING = {"default_template": "d", "section_defaults": {"A": "of_a"}, "mappings": {"x": {"patterns": ["RFC (new)", 4734], "sections": ["A", "F"]}, "y": {"patterns": ["rfc"]}, "z": {}}, "skip_patterns": {"patterns": ["billing"]}}


def test_first_rule_that_fits(spark):
    rules = routing.TitleRules.of(MAPPING)
    rows = spark.createDataFrame([("My RFC (NEW) form", "F"), ("My RFC (NEW) form", "E"), ("Form 4734", "A"), ("Form 4734", "B"), ("none", "A"), ("none", "F"), ("RFC Billing", "F"), (None, "A"), (None, None)], "t STRING, s STRING")
    assert [r[0] for r in rows.select(rules.template(F.col("t"), F.col("s"))).collect()] == ["x", "y", "x", "d", "of_a", "d", None, "of_a", "d"]


def test_selection(spark):
    rules = {s: routing.SectionRule.of(c) for s, c in {"A": {"strategy": "latest_n", "latest_n": 2}, "B": {"include": False}, "E": {"strategy": "category_filter", "categories": {"include": ["good"]}}, "F": {"categories": {"exclude": ["bad"]}}}.items()}
    rows = [("c", "A", "x", 1, 1), ("c", "A", "x", 9, 2), ("c", "A", "x", 9, 3), ("c", "A", "x", 9, 4), ("d", "A", "x", 1, 1), ("c", "B", "x", 1, 5), ("c", "E", "a good one", 1, 6), ("c", "E", "x", 1, 7), ("c", "F", "bad", 1, 8), ("c", "F", "x", None, 9), ("c", "G", "x", 1, 10), ("c", None, None, 1, 11)]
    df = spark.createDataFrame(rows, "case_id STRING, section STRING, title STRING, page_start INT, ord INT")
    got = {(r.case_id, r.ord, r.category) for r in routing.selected(df, rules, {"good": ("GOOD",), "bad": ("bad",)}).collect()}
    assert got == {("c", 2, None), ("c", 3, None), ("d", 1, None), ("c", 6, "good"), ("c", 9, None)}
    assert routing.selected(df.limit(0), rules, {}).count() == 0


def test_means(spark):
    cases = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "case_id STRING")
    formats = spark.createDataFrame([("a", "court_transcript"), ("b", "processed"), ("c", "raw_ssa")], "case_id STRING, format STRING")
    assert [sorted(r[0] for r in routing.allowed(cases, formats, m).collect()) for m in ("text", "vision", "recovery")] == [list("bcd"), list("acd"), list("acd")]


def test_entry_blocks(spark):
    rows = [("2024-01-01", "visit", "Dr. A", "Clinic", "1F@2", "Text."), (None, None, "", "Clinic", None, ""), ("", "", None, None, "", None)]
    df = spark.createDataFrame(rows, "a STRING, b STRING, c STRING, d STRING, e STRING, f STRING")
    got = [r[0] for r in df.select(report.entry_block(*map(F.col, "abcdef"))).collect()]
    assert got == ["### 2024-01-01\n\n**visit**\n\nDr. A - Clinic\n\n**Source:** 1F@2\n\nText.\n", "### Unknown Date\n\nClinic\n", "### \n"]
