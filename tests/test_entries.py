from pyspark.sql import functions as F

from chartloom.operators import entries

ENTRY = "seq BIGINT, date STRING, visit_type STRING, sparse BOOLEAN, occurrence STRING"
KEYS = ["date", "visit_type"]


def test_validate_fills_missing_members_only(spark):
    rows = spark.createDataFrame([(1, {"date": "01/01/2024", "visit_type": "party"}), (2, {"date": ""}), (3, {}), (4, {"date": "x", "provider": None})], "id INT, entry MAP<STRING,STRING>").withColumn("ex", F.lit("1F"))
    got = {r.id: r for r in entries.validated(rows, "ex").collect()}
    assert set(got) == {1, 4}
    assert (got[1].provider, got[1].visit_type, got[1].exhibit_reference) == ("Not Specified", "office_visit", "1F")
    assert got[4].provider is None


def test_sparse(spark):
    rows = [("office_visit", {}), ("office_visit", None), ("office_visit", {"findings": ""}), ("office_visit", {"visit_type": "a long enough value"}), ("office_visit", {"findings": "enough to say something"}), (None, {"findings": "enough to say something"}), ("x", {"findings": "[]"}), ("x", {"findings": '["a"]'}), ("x", {"findings": '{"a": ""}'}), ("x", {"findings": '{"a": "b"}'})]
    df = spark.createDataFrame(rows, "v STRING, o MAP<STRING,STRING>")
    assert [r[0] for r in df.select(entries.is_sparse(F.col("v"), F.col("o"))).collect()] == [True, True, True, True, False, True, True, False, True, False]


def test_signature_and_merge(spark):
    rows = [(1, 0, 2, "d", "office_visit", "Dr. John Smith"), (2, 1, 2, "d", "office_visit", "dr. johnsmith"), (3, 1, 2, "e", "office_visit", None)]
    df = spark.createDataFrame(rows, "seq INT, chunk_index INT, total_chunks INT, date STRING, visit_type STRING, provider STRING").withColumn("x", F.lit("x"))
    assert df.select(entries.signature(F.col("date"), F.col("visit_type"), F.col("provider"))).first()[0] == "d|office_visit|dr.johnsmith"
    assert sorted((r.seq, r.from_chunk) for r in entries.merged_chunks(df, ["x"]).collect()) == [(1, None), (3, 1)]
    assert entries.merged_chunks(df.withColumn("total_chunks", F.lit(1)), ["x"]).count() == 3


def test_richest(spark):
    df = spark.createDataFrame([(1, "d", "v", True, "a"), (2, "d", "v", False, "b"), (3, "d", "v", False, "c"), (4, None, "v", True, "e")], ENTRY)
    assert sorted((r.seq, r.first_seq) for r in entries.richest(df, KEYS).collect()) == [(2, 1), (4, 4)]


def test_recover(spark):
    first = spark.createDataFrame([(1, "d", "v", True, "-"), (2, "e", "v", False, "kept"), (3, "f", "v", True, "-")], ENTRY)
    second = spark.createDataFrame([(9, "d", "v", False, "new"), (10, "d", "v", False, "later"), (11, "f", "v", True, "-"), (12, "g", "v", False, "added"), (13, "h", "v", True, "-")], ENTRY)
    got = sorted((r.seq, r.occurrence, r.enriched) for r in entries.recovered(first, second, KEYS).collect())
    assert got == [(1, "new", True), (2, "kept", False), (3, "-", False), (12, "added", True)]


def test_consume_one_for_one(spark):
    left = spark.createDataFrame([(1, "d", "v", True, ""), (2, "d", "v", True, ""), (3, "e", "v", True, "")], ENTRY)
    right = spark.createDataFrame([(8, "d", "v", False, ""), (9, "f", "v", False, "")], ENTRY)
    assert sorted((r.sparse_seq or 0, r.retry_seq or 0, r.outcome) for r in entries.consumed(left, right, KEYS).collect()) == [(0, 9, "appended"), (1, 8, "filled"), (2, 0, "leftover"), (3, 0, "leftover")]


def test_visit_types(spark):
    df = spark.createDataFrame([("MRI of the knee",), (None,), ("",)], "t STRING")
    assert [r[0] for r in df.select(entries.visit_types_of(F.col("t"))).collect()] == [["imaging_report", "office_visit"], ["office_visit"], ["office_visit"]]
    occurrence = spark.createDataFrame([({"test": "x"},), ({"test": "[]", "therapy_type": "pt"},), ({},)], "o MAP<STRING,STRING>")
    assert [r[0] for r in occurrence.select(entries.inferred_visit_type(F.col("o"))).collect()] == ["lab_result", "therapy_eval", "office_visit"]


def test_occurrences_of_nested_visits(spark):
    import json

    from chartloom.operators import occurrences

    said = [
        ("consultative_exam", {"ce_type": "Psych", "examiner_specialty": "neuro", "diagnostic_impression": ["a", "b"], "mental_findings": {"mood_affect": "flat"}, "prognosis": "fair", "extra": "y" * 250}),
        ("psych_visit", {"mental_status_exam": "calm", "plan": "z" * 200}),
        (None, {"test_name": "cbc"}),
        ("office_visit", {"visit_type": "x"}),
        ("office_visit", None),
    ]
    df = spark.createDataFrame([(v, json.dumps(o) if o is not None else None) for v, o in said], "v STRING, o STRING").withColumn("o", F.from_json("o", "map<string,string>"))
    got = [r[0] for r in df.select(occurrences.occurrence_text(F.col("v"), F.col("o"), F.lit("raw\ntext"))).collect()]
    assert got[0] == "**Psych CE** (neuro)<br>**MSE:** Mood/Affect: flat<br>**Impression:** a; b<br>**Prognosis:** fair<br>**Extra:** " + "y" * 200 + "..."
    assert got[1] == "**MSE:** calm<br>**Plan:** " + "z" * 150 + "..."
    assert got[2] == "**Test Name:** cbc"
    assert got[3] == got[4] == "**[Review Required]** Content extraction incomplete.<br>**Raw snippet:** raw text..."


def test_occurrences_that_are_plain_text(spark):
    rows = spark.createDataFrame([("office_visit", "  short text  "), ("office_visit", "a text of twenty signs"), ("", "a text of twenty signs"), ("office_visit", None)], "v STRING, t STRING")
    none = F.lit(None).cast("map<string,string>")
    assert [r[0] for r in rows.select(entries.is_sparse(F.col("v"), none, said=F.col("t"))).collect()] == [True, False, True, True]


def test_consumed_with_one_hot_key(spark):
    left = spark.createDataFrame([("k", i) for i in range(0, 900, 2)] + [("m", 1)], "k STRING, seq INT")
    right = spark.createDataFrame([("k", i) for i in range(1, 601, 2)] + [("n", 1)], "k STRING, seq INT")
    got = {(r.k, r.sparse_seq, r.retry_seq, r.outcome) for r in entries.consumed(left, right, ["k"]).collect()}
    want = {("k", 2 * i, 2 * i + 1 if i < 300 else None, "filled" if i < 300 else "leftover") for i in range(450)} | {("m", 1, None, "leftover"), ("n", None, 1, "appended")}
    assert got == want
