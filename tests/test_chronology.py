import datetime as dt
import json

from pyspark.sql import functions as F

from chartloom.functions import citations as cite
from chartloom.functions import dates, text
from chartloom.operators import chronology

ROW = "case_id STRING, seq INT, date DATE, provider STRING, facility STRING, occurrence STRING, source STRING"
D = dt.date(2024, 1, 15)


def combined(spark, *sources):
    df = spark.createDataFrame([("c", s) for s in sources], "k STRING, s STRING")
    return chronology.combined_sources(df, ["k"], "s").first().combined_source


def test_combine_sources(spark):
    assert combined(spark, "1F@52", "1F@53", "1F@55") == "1F@52-55"
    assert combined(spark, "10F@1", "2F@9") == "10F@1, 2F@9"
    assert combined(spark, "1F@52-55", "1F@53") == "1F@52-53"
    assert combined(spark, "x", "1F@2", "1F@2") == "1F@2"
    assert combined(spark, "b", "a", "b") == "a, b"
    assert combined(spark, "1F@52-55") == "1F@52-55"


def test_lab_panels_and_duplicates(spark):
    rows = [("c", 1, D, "p", "f", "**Test:** a", "1F@2"), ("c", 2, D, "p", "f", "**test:** b", "1F@5"), ("c", 3, D, "p", "f", "visit", "1F@9"), ("c", 4, D, "p", "f", "visit", "1F@9"), ("c", 5, D, None, None, "**Test:** c", None)]
    got = {r.seq: (r.occurrence, r.source) for r in chronology.processed(spark.createDataFrame(rows, ROW), ["case_id"]).collect()}
    assert got == {1: ("**Test:** a<br><br>**test:** b", "1F@2-5"), 3: ("visit", "1F@9"), 5: ("**Test:** c", None)}


def test_footer_in_the_order_of_numbers(spark):
    rows = [("c", "10F", 500), ("c", "5F", 104), ("c", "5F", 100), ("c", "5F", 100), ("c", None, 999), ("c", "1F", None)]
    got = chronology.footer(spark.createDataFrame(rows, "k STRING, exhibit_id STRING, absolute_page INT"), ["k"]).orderBy("place").collect()
    assert [r.line for r in got] == ["- **Exhibit 5F**: 2 citation(s), pp.100-104", "- **Exhibit 10F**: 1 citation(s), p.500", "- **Other Sources**: 1 citation(s), p.999"]


def test_diagnoses_stop_at_the_next_label(spark):
    rows = [("c", "**Dx:** asthma; gout,x<br>**Plan:** rest"), ("c", "**Dx:** asthma"), ("c", "none"), ("c", None)]
    got = chronology.diagnoses(spark.createDataFrame(rows, "k STRING, t STRING"), ["k"], "t").orderBy("number").collect()
    assert [(r.number, r.diagnosis) for r in got] == [(1, "asthma"), (2, "gout")]


def test_dates(spark):
    df = spark.createDataFrame([("2024-01-15",), ("6/2/2024",), ("06-20-2024",), ("02/30/2024",), ("6/2/24",), (" 6/2/2024",), (None,), ("",)], "d STRING")
    assert [r[0] for r in df.select(dates.parsed(F.col("d"))).collect()] == [dt.date(2024, 1, 15), dt.date(2024, 6, 2), dt.date(2024, 6, 20), None, None, None, None, None]


def test_span_and_confidence(spark):
    df = spark.createDataFrame([("a", "2024-01-15", "p"), ("a", "06/20/2024", None), ("b", None, "p")], "k STRING, d STRING, p STRING")
    assert {r.k: r.span for r in chronology.date_span(df, ["k"], "d").collect()} == {"a": "2024-01-15 to 2024-06-20", "b": "No dated events"}
    assert {r.k: round(r.confidence, 3) for r in chronology.confidence(df, ["k"], F.lit(0.5), "p", "d").collect()} == {"a": 0.567, "b": 0.233}


def test_text_functions(spark):
    df = spark.createDataFrame([("123-45-6789",), ("6789",), (None,), ("",)], "s STRING")
    assert [r[0] for r in df.select(text.masked_ssn(F.col("s"))).collect()] == ["XXX-XX-6789", "XXX-XX-6789", "", ""]
    one = spark.createDataFrame([("range_of_3d_motion", "a <b> & 'c' | \"d\"", "Ex. 1F, pp. 52-55 pp.52 of 55", " É  x-ray, 3! ")], "k STRING, h STRING, v STRING, n STRING")
    assert tuple(one.select(text.label(F.col("k")), text.escaped_html(F.col("h"), pipes=True), cite.from_verbose(F.col("v")), text.normalized_for_match(F.col("n"))).first()) == ("Range Of 3D Motion", "a &lt;b&gt; &amp; &#39;c&#39; / &quot;d&quot;", "1F@52-55", "é x ray 3")
    assert one.select(text.without_court_stamps(F.lit("Case 4:20-cv-1 Filed 01/15/2020 Page 3 of 5 EXHIBIT 1F Seen today"))).first()[0] == "Seen today"
    assert one.select(text.with_legal_citations(F.lit("42 U.S.C. § 405"))).first()[0] == '<cite class="statute-citation">42 U.S.C. § 405</cite>'


def test_rendered(spark):
    said = json.dumps({"visit_type": "x", "chief_complaint": "pain", "meds": '["a", "b"]', "vitals": '{"bp": "1", "hr": ""}', "none": "", "long": "y" * 500})
    df = spark.createDataFrame([(said,), (None,), ("{}",)], "o STRING").withColumn("o", F.from_json("o", "map<string,string>"))  # keeps the order of members
    got = [r[0] for r in df.select(chronology.rendered(F.col("o"), " / ")).collect()]
    assert got[0] == "**Chief Complaint:** pain / **Meds:** a, b / **Vitals:** bp: 1 / **Long:** " + "y" * 300 + "..."
    assert got[1] is None and got[2] == ""
    sections = F.array(F.struct(F.lit("meds").alias("field"), F.lit("Rx").alias("label"), F.lit(None).cast("int").alias("max_len")), F.struct(F.lit("chief_complaint").alias("field"), F.lit("CC").alias("label"), F.lit(2).alias("max_len")))
    assert df.select(chronology.rendered_by_template(F.col("o"), sections)).first()[0].startswith("**Rx:** a; b<br>**CC:** pa...<br>**Vitals:**")


def test_report_rows(spark):
    rows = spark.createDataFrame([("c", 2, D, "a|b", None, "<x>", "s"), ("c", 1, D, "p", "f", "o", "s")], ROW)
    lines = chronology.markdown_table(rows, ["case_id"]).first().markdown.split("\n")
    assert lines[2:] == ["| 01/15/2024 | p | f | o | s |", "| 01/15/2024 | a\\|b |  | <x> | s |"]
    assert "<td>&lt;x&gt;</td>" in [r.html for r in chronology.html_rows(rows).collect() if r.seq == 2][0]
