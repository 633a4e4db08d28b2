import json

import pytest
from pyspark.sql import functions as F

from chartloom.plans import chronology as plan
from chartloom.sources import jobs, pages, providers, templates


def test_failing_chunk_costs_no_other(spark):
    class Sometimes:
        def generate(self, prompt):
            if "bad" in prompt:
                raise ValueError("no")
            return prompt.upper()

    df = spark.createDataFrame([("a", 0, "ok"), ("a", 1, "bad"), ("b", 0, None)], "exhibit_id STRING, chunk_index INT, text STRING")
    got = {(r.exhibit_id, r.chunk_index): (r.response, r.attempts, r.error) for r in providers.extract(df, Sometimes()).collect()}
    assert got == {("a", 0): ("OK", 1, None), ("a", 1): (None, 1, "ValueError: no"), ("b", 0): ("", 1, None)}


def test_repeats_and_pace():
    class Late:
        calls = 0

        def generate(self, prompt):
            self.calls += 1
            if self.calls < 3:
                raise RuntimeError("Throttling")
            return "x"

    waits = []
    assert providers.called(Late(), "", sleep=waits.append) == ("x", 3, None) and waits == [1.0, 2.0]
    now = [0.0]
    pace = providers.Pace(2, 60.0, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(5):
        pace.take()
    assert now[0] == 120.0


def test_pages_of_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\ftwo\fthree")
    got = pages.read_pages(spark, str(tmp_path / "*.txt"), pages.form_feed_decoder, first=2).orderBy("page").collect()
    assert [(r.page, r.text, r.content_type) for r in got] == [(2, "two", "text"), (3, "three", "text")]
    with pytest.raises(Exception, match="no decoder"):
        pages.read_pages(spark, str(tmp_path / "*.txt")).collect()


def test_templates(spark, tmp_path):
    (tmp_path / "base.yaml").write_text("fields: {x: {}}")
    (tmp_path / "office_visit.yaml").write_text("output_labels: [Dx, CC]\nfields:\n  cc: {label: CC, max_len: 5}\n  dx: {label: Dx, type: array}\n  plan_of_care: {}\n")
    got = [(r.visit_type, r.field, r.label, r.max_len) for r in templates.fields(spark, tmp_path).orderBy("place").collect()]
    assert got == [("office_visit", "dx", "Dx", None), ("office_visit", "cc", "CC", 5), ("office_visit", "plan_of_care", "Plan Of Care", None)]
    assert templates.load(tmp_path / "none.yaml") == {} and templates.first_existing(tmp_path / "no", tmp_path) == tmp_path


def test_jobs(spark, tmp_path):
    (tmp_path / "job_1.json").write_text(json.dumps({"job_id": "1", "status": "completed", "created_at": "2024-01-01T00:00:00"}))
    (tmp_path / "job_2.json").write_text("{broken")
    rows = jobs.read_jobs(spark, str(tmp_path / "job_*.json"))
    assert [(r.job_id, str(r.created_at)) for r in rows.collect()] == [("1", "2024-01-01 00:00:00")]
    jobs.write_finished(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().status == "completed"
    schema = "job_id STRING, status STRING, updated_at TIMESTAMP"
    at = lambda s: F.lit(s).cast("timestamp")
    make = lambda rows: spark.createDataFrame(rows, "job_id STRING, status STRING, t STRING").select("job_id", "status", F.col("t").cast("timestamp").alias("updated_at"))
    held, changes = make([("1", "queued", "2024-01-02 00:00:00"), ("2", "queued", "2023-01-01 00:00:00")]), make([("1", "done", "2024-01-02 01:00:00"), ("1", None, "2024-01-02 02:00:00")])
    assert schema and [(r.job_id, r.status) for r in jobs.upserted(held, changes, at("2024-01-02 03:00:00")).collect()] == [("1", "done")]
    assert jobs.listed(held.withColumn("created_at", F.col("updated_at")), "queued", 1).first().job_id == "1"


def test_whole_run(spark):
    toc = spark.createDataFrame([("c", 1, 2, "1F - Notes", 1), ("c", 2, 2, "2F - More", 3)], "case_id STRING, ord INT, level INT, title STRING, page_start INT")
    counts = spark.createDataFrame([("c", 3)], "case_id STRING, total_pages INT")
    text = spark.createDataFrame([("c", 1, "1F - 1 of 2\nSeen 01/15/2024 for low back pain."), ("c", 2, "1F - 2 of 2\nSeen 02/20/2024 for knee pain."), ("c", 3, " ")], "case_id STRING, page INT, text STRING")
    rows = plan.run(toc, counts, text, providers.RuleProvider(), plan.Options(calls_per_minute=None)).orderBy("date").collect()
    assert [(str(r.date), r.source) for r in rows] == [("2024-01-15", "1F@1 (p.1)"), ("2024-02-20", "1F@2 (p.2)")]
    assert "low back pain" in rows[0].occurrence


def test_whole_run_reads_long_exhibits_to_their_end(spark):
    toc = spark.createDataFrame([("c", 1, 2, "1F - Notes", 1), ("c", 2, 2, "2F - More", 71)], "case_id STRING, ord INT, level INT, title STRING, page_start INT")
    counts = spark.createDataFrame([("c", 140)], "case_id STRING, total_pages INT")
    text = spark.createDataFrame([("c", p, f"Seen 01/{p % 28 + 1:02d}/2024 for knee pain.") for p in (1, 50, 51, 70, 140)], "case_id STRING, page INT, text STRING")
    sources = lambda options: {r.source for r in plan.run(toc, counts, text, providers.RuleProvider(), options).collect()}
    assert sources(plan.Options(calls_per_minute=None)) == {"1F@1 (p.1)", "1F@50 (p.50)", "1F@51 (p.51)", "1F@70 (p.70)", "2F@70 (p.140)"}
    assert sources(plan.Options(calls_per_minute=None, pages_per_exhibit=50)) == {"1F@1 (p.1)", "1F@50 (p.50)"}


def test_rule_provider_keeps_long_findings():
    said = " ".join(["pain"] * 200)
    assert json.loads(providers.RuleProvider().generate(f"Seen 01/15/2024 {said}"))["entries"][0]["occurrence_treatment"]["findings"] == said


def test_report(spark, tmp_path):
    import datetime as dt

    from chartloom.plans import report

    people = spark.createDataFrame([("c", "A|B", "123-45-6789", None, None, "r", 3), ("d", "X", None, dt.datetime(1970, 1, 2), "b", "r", 1)], "case_id STRING, full_name STRING, ssn STRING, date_of_birth TIMESTAMP, bnc_code STRING, case_file_reference STRING, total_document_pages INT")
    seen = spark.createDataFrame([("c", 2, dt.date(2024, 1, 1), "p", "f", "late", "s"), ("c", 1, dt.date(2024, 1, 1), "p", "f", "early", "s"), ("c", 9, dt.date(1960, 1, 1), "p", "f", "first", "s")], "case_id STRING, seq INT, date DATE, provider STRING, facility STRING, occurrence STRING, source STRING")
    made = report.ReportBuilder(people).claimants(people).chronology(seen)
    text = {r.case_id: r.report for r in made.markdown().collect()}
    assert text["c"].index("first") < text["c"].index("early") < text["c"].index("late")
    assert "| **Full Name** | A\\|B | **SSN** | XXX-XX-6789 |\n| **Date of Birth** |  | **BNC Code** | N/A |\n| **Case File Reference** | r | **Total Document Pages** | 3 |" in text["c"] and "| **Date of Birth** | 01/02/1970 |" in text["d"]
    assert "| N/A | No medical events documented | N/A | N/A | N/A |" in text["d"] and text["c"].count("## SECTION") == 12
    assert len(json.loads(made.json().first().report)["sections"]) == 12
    report.write_reports(made.markdown(), str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).select("case_id").distinct().count() == 2
    assert report.ReportBuilder(people).sections().where("lines > 0").count() == 0
    report.write_lines(made.lines(), str(tmp_path / "l"))
    kept = "".join(p.read_text() for p in sorted((tmp_path / "l" / "case_id=c").glob("part-*")))
    assert kept == "\n".join(r.markdown for r in made.sections().where("case_id = 'c'").orderBy("section").collect()) + "\n"


def test_administrative_section_and_lists(spark):
    from chartloom.plans import report

    people = spark.createDataFrame([("c",), ("d",)], "case_id STRING")
    dates_ = spark.createDataFrame([("c", "DIB", None, None, None, None, None, None)], "case_id STRING, claim_type STRING, protective_filing_date DATE, alleged_onset_date DATE, date_last_insured DATE, initial_denial_date DATE, reconsideration_denial_date DATE, alj_hearing_date DATE")
    gaps = spark.createDataFrame([("c", 1, None, "2019"), ("c", 2, "No records", ""), ("x", 3, "of no case asked for", "")], "case_id STRING, n INT, gap_description STRING, time_period STRING")
    got = {(r.case_id, r.section): r.markdown for r in report.ReportBuilder(people).administrative(dates_).gaps(gaps, "n").sections().collect()}
    assert len(got) == 24 and got["c", 1].splitlines()[-4:] == [
        "| **Claim Type** | DIB | **Initial Denial** | N/A |", "| **Protective Filing Date (PFD)** | N/A | **Reconsideration Denial** | N/A |",
        "| **Alleged Onset Date (AOD)** | N/A | **ALJ Hearing Date** | N/A |", "| **Date Last Insured (DLI)** | N/A |  |  |",
    ]
    assert got["c", 10].splitlines()[-2:] == ["- Unknown gap (2019)", "- No records"] and got["d", 10].endswith("No significant gaps in medical evidence identified.")


def test_errors_worth_repeating():
    def raised(kind, said="", response=None):
        error = type(kind, (Exception,), {})(said)
        if response is not None:
            error.response = response
        return providers.worth_repeating(error)

    assert raised("InternalServerException") and raised("ReadTimeoutError") and raised("X", "Rate limit exceeded") and raised("X", "no Capacity left")
    assert raised("ClientError", "x", {"Error": {"Code": "ThrottlingException"}}) and raised("X", "Too Many Requests")
    # Parts of other words, and errors that stay, aren't.
    assert not raised("ValueError", "cannot generate beyond the limitation") and not raised("ClientError", "x", {"Error": {"Code": "AccessDenied"}}) and not raised("X", "", {}) and not raised("X", "temporary")


def eyes():
    """Reads an entry from each batch, with the size of its images; fails on images that begin with 0."""

    class Eyes:
        def generate_with_vision(self, prompt, images):
            if any(x[:1] == b"0" for x in images):
                raise ValueError("no")
            return json.dumps([{"date": "03/01/2024", "provider": f"{len(images)} images", "occurrence_treatment": {"findings": prompt[-60:]}}])

    return Eyes()


def test_scanned_pages_are_read_in_batches(spark):
    toc = spark.createDataFrame([("c", 1, 2, "1F - Notes", 1), ("c", 2, 2, "2F - More", 13), ("t", 1, 1, "Certification", 1), ("t", 2, 2, "1F - x", 2), ("p", 1, 1, "Table of Contents", 1), ("p", 2, 2, "1F - x", 2)], "case_id STRING, ord INT, level INT, title STRING, page_start INT")
    counts = spark.createDataFrame([("c", 20), ("t", 9), ("p", 9)], "case_id STRING, total_pages INT")
    images = spark.createDataFrame([("c", p, b"1") for p in range(1, 13)] + [("c", 14, b"1"), ("c", 15, None), ("c", 17, b"0"), ("t", 3, b"1"), ("p", 3, b"1"), ("x", 1, b"1")], "case_id STRING, page INT, image BINARY")
    text = spark.createDataFrame([("c", 20, "Seen 01/15/2024 for pain."), ("t", 4, "Seen 01/15/2024 for pain."), ("p", 4, "Seen 01/15/2024 for pain.")], "case_id STRING, page INT, text STRING")
    from chartloom.operators import segments

    args = (toc, counts, text, providers.RuleProvider(), plan.Options(calls_per_minute=None), images, eyes())
    got = {(r.case_id, r.provider, r.source) for r in plan.run(*args, formats=segments.file_format(toc)).collect()}
    # The batch with a broken image costs no other: 14 and 17 are one batch. Court files are read by images, processed ones by text.
    assert got == {("c", "10 images", "1F@1-10 (pp.1-10)"), ("c", "2 images", "1F@11-12 (pp.11-12)"), ("c", "Not Specified", "2F@8 (p.20)"), ("t", "1 images", "1F@2 (p.3)"), ("p", "Not Specified", "1F@3 (p.4)")}
    assert plan.run(*args).where("case_id = 't'").count() == 2


def test_determinations_of_cases(spark):
    from chartloom.plans import determination

    class Reader:
        def generate(self, prompt):
            if "fail" in prompt:
                raise ValueError("no")
            return '```json\n{"claimant_name": "' + prompt.split()[-1] + '", "claim_type": "DIB", "x": [1, 2'

        def generate_with_vision(self, prompt, images):
            return json.dumps({"case_metadata": {"claimant_name": f"{len(images)} seen"}})

    toc = spark.createDataFrame([(c, 1, "1A - DDE", 1, 3) for c in "abcd"] + [(c, 2, "2A - RFC Assessment", 4, 6) for c in "abcd"] + [("e", 1, "1F - DDE", 1, 2)], "case_id STRING, ord INT, title STRING, page_start INT, page_end INT")
    pages = spark.createDataFrame([("a", 1, "old", None), ("a", 4, "by", None), ("a", 5, "Ann", None), ("b", 4, "dropped", None), ("b", 5, None, b"i"), ("b", 6, "", b"i"), ("c", 4, " ", None), ("d", 4, "fail", None), ("e", 1, "x", None)], "case_id STRING, page INT, text STRING, image BINARY")
    got = {r.case_id: (r.extraction_mode, json.loads(r.fields), r.confidence, r.error) for r in determination.parsed(toc, pages, Reader(), Reader(), None).collect()}
    assert got == {"a": ("text", {"claimant_name": "Ann", "claim_type": "DIB", "x": [1, 2]}, 0.4, None), "b": ("vision", {"case_metadata": {"claimant_name": "2 seen"}}, 0.2, None), "c": ("text", {}, 0.0, "No text extracted"), "d": ("text", {}, 0.0, "ValueError: no")}


def test_prompts():
    assert providers.filled('{a} {"date": "{b}"} {c}', a=1, b="x") == '1 {"date": "x"} {c}'
