from pyspark.sql import functions as F

from chartloom.functions import citations as cite
from chartloom.operators import citations

RANGES = [("c", 1, "1F", 100, 110), ("c", 2, "2F", 111, 150), ("c", 3, "3F", 151, 200), ("c", 4, "", 1, 9), ("c", 5, "9F", 0, 9), ("c", 6, "8F", 9, 3)]
RANGE_SCHEMA = "case_id STRING, ord INT, exhibit_id STRING, start_page INT, end_page INT"


def index(spark, extra=()):
    return citations.page_index(spark.createDataFrame([*RANGES, *extra], RANGE_SCHEMA), ["case_id"])


def test_resolve_and_format(spark):
    pages = spark.createDataFrame([("c", p) for p in (105, 100, 110, 50)], "case_id STRING, page_no INT")
    found = citations.resolve(pages, index(spark), ["case_id"], "page_no")
    text = {r.page_no: r.t for r in found.select("page_no", cite.resolved(F.col("exhibit_id"), F.col("relative_page"), F.col("page_no")).alias("t")).collect()}
    assert text == {105: "Ex. 1F@6 (p.105)", 100: "Ex. 1F@1 (p.100)", 110: "Ex. 1F@11 (p.110)", 50: "p.50"}


def test_last_of_overlapping_ranges_holds(spark):
    rows = index(spark, [("c", 9, "7F", 105, 106)]).where("page in (104, 105)").collect()
    assert {(r.page, r.exhibit_id, r.relative_page) for r in rows} == {(104, "1F", 5), (105, "7F", 1)}


def test_format_range(spark):
    pages = spark.createDataFrame([("c", a, b) for a, b in ((100, 105), (105, 115), (10, 20), (100, 300))], "case_id STRING, a INT, b INT")
    at = index(spark)
    both = citations.resolve(citations.resolve(pages, at, ["case_id"], "a"), at, ["case_id"], "b", "end_")
    text = {(r.a, r.b): r.t for r in both.select("a", "b", cite.resolved_range(*map(F.col, ("exhibit_id", "relative_page", "a", "end_exhibit_id", "end_relative_page", "b"))).alias("t")).collect()}
    assert text == {(100, 105): "Ex. 1F@1-6 (pp.100-105)", (105, 115): "pp.105-115", (10, 20): "pp.10-20", (100, 300): "pp.100-300"}


def test_citation_styles(spark):
    row = spark.range(1)
    lit = lambda x: F.lit(x) if x is not None else F.lit(None).cast("int")
    def text(ex, rel, page, end_page=None, end_rel=None, guess=False, bates=None, style="full"):  # noqa: E306
        return row.select(cite.citation(lit(page), F.lit(ex).cast("string"), lit(rel), lit(end_page), lit(end_rel), F.lit(guess), F.lit(bates).cast("string"), style)).first()[0]

    assert text("25F", 33, 1847) == "25F@33 (p.1847)"
    assert text("25F", 33, 1847, style="exhibit") == "Ex. 25F@33"
    assert text("25F", 33, 1847, style="absolute") == "p.1847"
    assert text("25F", 33, 1847, guess=True) == "25F@~33 (p.1847)"
    assert text("25F", 33, 1847, 1849, 35) == "25F@33-35 (pp.1847-1849)"
    assert text(None, None, 1847) == "p.1847"
    assert text("25F", 33, 1847, bates="ABC000123") == "ABC000123"


def matched(spark, entries, pages, threshold=3.0):
    schema = "entry_id STRING, case_id STRING, date STRING, provider STRING, facility STRING, dx ARRAY<STRING>"
    rows = spark.createDataFrame(entries, schema)
    terms = citations.search_terms(F.col("date"), F.col("provider"), F.col("facility"), F.col("dx"))
    texts = spark.createDataFrame(pages, "case_id STRING, absolute_page INT, text STRING")
    return {r.entry_id: r for r in citations.match_pages(rows.select("entry_id", "case_id", terms.alias("terms")), texts, ["case_id"], threshold).collect()}


PAGES = [("c", 100, "Date: 01/15/2024 Dr. Smith, General Hospital. Diabetes mellitus type 2."), ("c", 101, "01/20/2024 Dr. Jones at County Clinic"), ("c", 102, "nothing")]


def test_match_takes_the_best_page(spark):
    found = matched(spark, [("a", "c", "01/15/2024", "Dr. Smith", "General Hospital", ["Diabetes mellitus type 2"]), ("b", "c", "01/20/2024", "Dr. Jones", "County Clinic", None), ("n", "c", "12/31/2099", "Dr. Nonexistent", "Unknown Hospital", []), ("o", "z", "1", None, None, None)], PAGES)
    assert (found["a"].absolute_page, found["a"].match_score, found["a"].match_method, found["a"].confidence) == (100, 8.0, "search", 0.8)
    assert (found["b"].absolute_page, found["b"].match_score) == (101, 7.0)
    assert (found["n"].absolute_page, found["n"].match_method, found["n"].is_estimated, found["n"].confidence) == (100, "fallback", True, 0.3)
    assert "o" not in found


def test_tie_goes_to_the_earliest_page_and_neighbors_join(spark):
    pages = [("c", 101, "01/15/2024 dr smith"), ("c", 100, "01/15/2024 dr smith"), ("c", 103, "01/15/2024 dr smith")]
    row = matched(spark, [("a", "c", "01/15/2024", "Dr. Smith", None, None)], pages)["a"]
    assert (row.absolute_page, row.end_absolute_page, row.match_score) == (100, 101, 5.0)


def test_skipped_terms(spark):
    rows = spark.createDataFrame([(" ", "N/A", "Unknown", ["ab", "Asthma", "third"])], "d STRING, p STRING, f STRING, x ARRAY<STRING>")
    terms = rows.select(citations.search_terms(F.col("d"), F.col("p"), F.col("f"), F.col("x"))).first()[0]
    assert [tuple(t) for t in terms] == [("Asthma", 1.0, True)]


def header(spark, text, page=1847, exhibit="25F", start=1815, total=74):
    row = spark.createDataFrame([(text, page, exhibit, start, total)], "t STRING, p INT, e STRING, s INT, n INT")
    return row.select(citations.header(F.col("t"), F.col("p"), F.col("e"), F.col("s"), F.col("n")).alias("h")).first().h


def test_headers(spark):
    h = header(spark, "25F - 33 of 74 and more")
    assert (h.source_type, h.exhibit_id, h.relative_page, h.total_pages, h.confidence, h.detection_method) == ("ere", "25F", 33, 74, 0.95, "regex")
    assert header(spark, "EXHIBIT NO. 25F\nPAGE: 33 OF 74").relative_page == 33
    assert header(spark, "25F – 33 of 74").relative_page == 33
    h = header(spark, "no header")
    assert (h.detection_method, h.relative_page, h.is_estimated) == ("position", 33, True)
    h = header(spark, "no header", exhibit=None, start=None, total=None)
    assert (h.source_type, h.confidence) == ("generic", 0.25)
    assert header(spark, "ABC000123\nx", exhibit=None, start=None, total=None).bates_number == "ABC000123"
    h = header(spark, "Page 45 of 120\nQ: x", exhibit=None, start=None, total=None)
    assert (h.source_type, h.relative_page, h.total_pages) == ("transcript", 45, 120)
    assert header(spark, None, exhibit=None, start=None, total=None).detection_method == "fallback"


def test_combined_text(spark):
    rows = [("c", 2, "Second page", 0.51), ("c", 1, "First page", 0.9), ("d", 1847, "x", 0.5), ("d", 1848, None, 0.5)]
    got = {r.k: r.combined_text for r in citations.combined_text(spark.createDataFrame(rows, "k STRING, absolute_page INT, text STRING, confidence DOUBLE"), ["k"]).collect()}
    assert got == {"c": "First page\n\nSecond page", "d": "[PAGE 1847]\nx"}


def test_ranges_of_any_length(spark):
    ranges = spark.createDataFrame([("c", "1F", 1, 2_147_483_647, 1), ("c", "2F", 50, 60, 2), ("d", "3F", 5, 250_007, 1), ("e", "4F", 1, 9, 1), ("c", None, 1, 9, 3), ("c", "5F", 9, 1, 4)], "case_id STRING, exhibit_id STRING, start_page INT, end_page INT, ord INT")
    rows = spark.createDataFrame([("c", 7), ("c", 55), ("c", 2_000_061), ("d", 250_007), ("d", 250_008), ("d", 5), ("e", None), ("x", 1)], "case_id STRING, page INT")
    index = citations.page_index(ranges, ["case_id"], rows.where("case_id <> 'c' OR page < 100"), "page")
    got = {(r.case_id, r.page): (r.exhibit_id, r.relative_page) for r in citations.resolve(rows, index, ["case_id"], "page").collect()}
    assert got == {("c", 7): ("1F", 7), ("c", 55): ("2F", 6), ("c", 2_000_061): (None, None), ("d", 250_007): ("3F", 250_003), ("d", 250_008): (None, None), ("d", 5): ("3F", 1), ("e", None): (None, None), ("x", 1): (None, None)}
    assert index.where("case_id = 'd'").count() == 250_003 and index.where("case_id = 'e'").count() == 0
