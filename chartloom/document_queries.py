"""Queries over reports, routing and determinations, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.operators import citations, longitudinal, repair, routing, segments
from chartloom.plans import determination, report
from chartloom.queries import query
from chartloom.reference_queries import _CHRON, _DAY, EVENTS, TOC, chronology_rows, dates, event_rows, toc_rows
from chartloom.session import table

# ---------------------------------------------------------------- bookmarks and routing


@query(
    f"""SELECT bookmark_id FROM {TOC} WHERE regexp_matches(upper(title),
        'DDE|DISABILITY DETERMINATION|RFC ASSESSMENT|RESIDUAL FUNCTIONAL CAPACITY|PRTF|PSYCHIATRIC REVIEW TECHNIQUE|STATE AGENCY|MEDICAL CONSULTANT|PSYCHOLOGICAL CONSULTANT|CASE ANALYSIS|RATIONALE|4734')
    OR contains(title, 'Statement')"""
)
def dde_titles(spark: SparkSession, d: str) -> DataFrame:
    """Determinations among all titles. The tables hold few, so statements count as titled "RFC Assessment" beside them."""
    t = F.when(F.col("title").contains("Statement"), F.concat("title", F.lit(" (RFC Assessment)"))).otherwise(F.col("title"))
    return toc_rows(spark, d).where(segments.is_dde(t)).select("bookmark_id")


@query(
    f"""SELECT case_id, arg_max(exhibit_id, {{'p': page_start, 'o': -ord}}) AS exhibit_id, max(page_start) AS page_start FROM (SELECT case_id, ord, page_start, regexp_extract(title, '^(\\d+A)\\b', 1) AS exhibit_id FROM {TOC}
        WHERE regexp_matches(title, '^\\d+A\\b') AND (contains(title, 'Statement') OR contains(title, 'Exam')) AND page_start IS NOT NULL) GROUP BY case_id"""
)
def latest_determination(spark: SparkSession, d: str) -> DataFrame:
    titled = F.regexp_replace("title", "Statement|Exam", "State Agency")
    rows = toc_rows(spark, d).where("page_start IS NOT NULL").withColumn("title", titled)
    return determination.latest(rows).select("case_id", "exhibit_id", "page_start")


@query(
    f"""SELECT event_id, upper(coalesce(exhibit_reference, '')) LIKE '%F' OR contains(upper(coalesce(exhibit_reference, '')), 'F@') OR contains(upper(coalesce(exhibit_reference, '')), 'F:')
        OR regexp_matches(lower(coalesce(source_text, '')), 'medical|doctor|hospital|treatment|diagnosis|patient') AS medical FROM {EVENTS}"""
)
def medical_by_text(spark: SparkSession, d: str) -> DataFrame:
    rows = event_rows(spark, d, "exhibit_reference", "source_text")
    return rows.select("event_id", segments.is_medical_exhibit(F.col("source_text"), F.col("exhibit_reference")).alias("medical"))


#: Rules of the kind that a mapping file holds.
MAPPING = {
    "default_template": "office_visit",
    "section_defaults": {"A": "dde_assessment", "E": "disability_report"},
    "mappings": {
        "medical_source_statement": {"patterns": ["Source Statement", "RFC Questionnaire"], "sections": ["F", "E"]},
        "imaging_report": {"patterns": ["imaging", "X-ray", "MRI"], "sections": ["F"]},
        "lab_result": {"patterns": ["lab result", "CBC"], "sections": ["F"]},
        "emergency_visit": {"patterns": ["Emergency"]},
    },
    "skip_patterns": {"patterns": ["Inpatient", "Payment"]},
}


def sectioned(spark: SparkSession, d: str) -> DataFrame:
    return toc_rows(spark, d).withColumn("section", F.regexp_extract("title", r"^\d+([A-F])\b", 1)).where("section <> ''")


_SECTIONED = f"(SELECT *, regexp_extract(title, '^\\d+([A-F])\\b', 1) AS section FROM {TOC} WHERE regexp_matches(title, '^\\d+[A-F]\\b'))"


@query(
    f"""SELECT bookmark_id, CASE WHEN regexp_matches(title, '(?i)inpatient|payment') THEN NULL WHEN regexp_matches(title, '(?i)source statement|rfc questionnaire') AND section IN ('F', 'E') THEN 'medical_source_statement'
        WHEN regexp_matches(title, '(?i)imaging|x-ray|mri') AND section = 'F' THEN 'imaging_report' WHEN regexp_matches(title, '(?i)lab result|cbc') AND section = 'F' THEN 'lab_result' WHEN regexp_matches(title, '(?i)emergency') THEN 'emergency_visit'
        WHEN section = 'A' THEN 'dde_assessment' WHEN section = 'E' THEN 'disability_report' ELSE 'office_visit' END AS template FROM {_SECTIONED}"""
)
def title_templates(spark: SparkSession, d: str) -> DataFrame:
    return sectioned(spark, d).select("bookmark_id", routing.TitleRules.of(MAPPING).template(F.col("title"), F.col("section")).alias("template"))


#: Rules of the kind that a filter file holds, and what titles of a category hold.
FILTERS = {
    "A": {"include": True, "strategy": "latest_n", "latest_n": 2},
    "B": {"include": False, "strategy": "exclude_all"},
    "E": {"include": True, "strategy": "category_filter", "categories": {"include": ["opinions", "studies"], "exclude": []}},
    "F": {"include": True, "strategy": "include_all", "categories": {"exclude": ["emergencies"]}},
}
CATEGORIES = {"opinions": ("Statement", "Consultative"), "studies": ("Study", "Imaging"), "emergencies": ("Emergency",)}


@query(
    f"""WITH c AS (SELECT *, CASE WHEN regexp_matches(title, '(?i)statement|consultative') THEN 'opinions' WHEN regexp_matches(title, '(?i)study|imaging') THEN 'studies' WHEN regexp_matches(title, '(?i)emergency') THEN 'emergencies' END AS category FROM {_SECTIONED}),
    n AS (SELECT *, row_number() OVER (PARTITION BY case_id, section ORDER BY page_start DESC NULLS LAST, ord) AS n FROM c)
    SELECT bookmark_id, category FROM n WHERE (section = 'A' AND n <= 2) OR (section = 'E' AND category IN ('opinions', 'studies')) OR (section = 'F' AND category IS DISTINCT FROM 'emergencies')"""
)
def exhibit_selection(spark: SparkSession, d: str) -> DataFrame:
    rules = {s: routing.SectionRule.of(c) for s, c in FILTERS.items()}
    return routing.selected(sectioned(spark, d), rules, CATEGORIES).select("bookmark_id", "category")


@query(
    f"""WITH r AS (SELECT case_id, level, lower(coalesce(title, '')) AS t, row_number() OVER (PARTITION BY case_id ORDER BY ord) AS n, row_number() OVER (PARTITION BY case_id, level ORDER BY ord) AS k FROM {TOC}),
    g AS (SELECT case_id, bool_or(n <= 5 AND (contains(t, 'certification') OR (contains(t, 'court') AND contains(t, 'index')))) OR count(*) FILTER (WHERE level = 2 AND regexp_matches(t, '^c\\d+[a-f]\\s*-')) >= 3 AS court,
        bool_or(n = 1 AND t = 'table of contents') OR count(*) FILTER (WHERE level = 3 AND k <= 20 AND regexp_matches(t, '^\\(page\\s+\\d+\\s+of\\s+\\d+\\)')) >= 3 AS done FROM r GROUP BY case_id),
    c AS (SELECT DISTINCT case_id FROM claimants)
    SELECT case_id, 'text' AS means FROM c WHERE case_id NOT IN (SELECT case_id FROM g WHERE court) UNION ALL SELECT case_id, m FROM c, (SELECT unnest(['vision', 'recovery']) AS m) WHERE case_id NOT IN (SELECT case_id FROM g WHERE done AND NOT court)"""
)
def format_routing(spark: SparkSession, d: str) -> DataFrame:
    formats = segments.file_format(toc_rows(spark, d))
    cases = table(spark, d, "claimants").select("case_id").distinct()
    ways = [routing.allowed(cases, formats, m).select("case_id", F.lit(m).alias("means")) for m in ("text", "vision", "recovery")]
    return ways[0].unionByName(ways[1]).unionByName(ways[2])


@query(f"SELECT event_id, 'position' AS how, source_page - 10 + 1 AS relative_page, 0.6::DOUBLE AS confidence FROM {EVENTS} WHERE source_page >= 10 UNION ALL SELECT event_id, 'fallback', NULL, 0.25::DOUBLE FROM {EVENTS} WHERE source_page < 10")
def header_positions(spark: SparkSession, d: str) -> DataFrame:
    """Pages without a header, in an exhibit that starts on page 10."""
    rows = event_rows(spark, d, "source_page").where("source_page IS NOT NULL")
    found = citations.header(F.lit("no header here"), F.col("source_page"), F.lit("1F"), F.lit(10), F.lit(None).cast("int"))
    return rows.select("event_id", found.alias("h")).select("event_id", F.col("h.detection_method").alias("how"), "h.relative_page", "h.confidence")


# ---------------------------------------------------------------- determinations


@query(
    """WITH r AS (SELECT DISTINCT dde_id, result_json AS t FROM dde_results WHERE json_valid(result_json) AND json_type(result_json) = 'OBJECT')
    SELECT dde_id, coalesce(t::JSON->'case_metadata'->>'claimant_name', t::JSON->>'claimant_name') AS claimant_name FROM r"""
)
def determinations_mended(spark: SparkSession, d: str) -> DataFrame:
    """Results with words around them and a piece of another behind: all are mended to what they were."""
    rows = table(spark, d, "dde_results").select("dde_id", "result_json").distinct().where(F.try_parse_json("result_json").isNotNull() & F.ltrim("result_json").startswith("{"))
    spoilt = F.when(F.col("dde_id") % 3 == 0, F.concat(F.lit("Here it is:\n```json\n"), "result_json", F.lit("\n``` Good luck."))).when(F.col("dde_id") % 3 == 1, F.concat(F.lit("The object is "), "result_json", F.lit(" as asked."))).otherwise(F.concat("result_json", F.lit("   ")))
    mended = repair.determinations(rows.select("dde_id", spoilt.alias("answer")), "dde_id", "answer")
    return repair.normalized(mended, "dde_id", "answer").select("dde_id", "claimant_name")


# ---------------------------------------------------------------- reports


def _reported(spark: SparkSession, d: str) -> report.ReportBuilder:
    claimants = table(spark, d, "claimants").select("claimant_id", "case_id", "full_name", "ssn", "date_of_birth", "bnc_code", "case_file_reference", "total_document_pages").distinct()
    known = table(spark, d, "diagnoses").select("diagnosis_id", "case_id", "diagnosis", "icd_code", "first_diagnosed", "provider").distinct()
    impairments = known.select("diagnosis_id", "case_id", "diagnosis", "icd_code", F.lit(None).cast("string").alias("severity"), F.col("first_diagnosed").alias("first_documented"), F.coalesce("provider", F.lit("")).alias("source"))
    events = event_rows(spark, d, "case_id", "date", "event_type", "description", "provider", "exhibit_reference", "location")
    cites = F.coalesce("exhibit_reference", F.lit(""))
    of = lambda kind: events.where(F.col("event_type") == kind).withColumn("date", dates.parsed(F.col("date"))).withColumn("source", cites)
    opinions = of("medical_source_statement").select("event_id", "case_id", "date", F.coalesce("provider", F.lit("")).alias("medical_source"), F.lit("treating").alias("relationship"), F.lit("statement").alias("opinion_type"), "source")
    surgeries = of("surgical_report").select("event_id", "case_id", "date", F.coalesce("description", F.lit("")).alias("procedure"), F.coalesce("location", F.lit("")).alias("facility_type"), "source")
    tests = of("diagnostic_study").select("event_id", "case_id", "date", F.coalesce("description", F.lit("")).alias("test_name"), F.lit(None).cast("string").alias("category"), F.lit("see text").alias("results_summary"), "source")
    gaps = longitudinal.treatment_gaps(events.select("case_id", dates.parsed(F.col("date")).alias("day")), ["case_id"], "day", 365)
    told = gaps.select("case_id", "gap_start", F.concat(F.col("days").cast("string"), F.lit(" days without treatment")).alias("gap_description"), F.concat(dates.written(F.col("gap_start")), F.lit(" - "), dates.written(F.col("gap_end"))).alias("time_period"))
    made = report.ReportBuilder(claimants).claimants(claimants).impairments(impairments).opinions(opinions, "event_id").surgeries(surgeries, "event_id").tests(tests, "event_id")
    return made.gaps(told, F.unix_date("gap_start")).chronology(chronology_rows(spark, d))


def _sql_line(*cells: str) -> str:
    return "'| ' || " + " || ' | ' || ".join(f"replace(coalesce({c}, ''), '|', '\\|')" for c in cells) + " || ' |'"


_US = "strftime({c}, '%m/%d/%Y')"
_HEADS = """
    (0, '## SECTION 1: CLAIMANT IDENTIFICATION\n\n| **Field** | **Value** | **Field** | **Value** |\n|-----------|-----------|-----------|-----------|', '| N/A | N/A | N/A | N/A |'),
    (1, '## SECTION 2: ADMINISTRATIVE DATA & CRITICAL DATES\n\n| **Case Information** | **Value** | **Denial Dates** | **Date** |\n|----------------------|-----------|------------------|----------|', '| N/A | N/A | N/A | N/A |'),
    (2, '## SECTION 3: ALLEGED IMPAIRMENTS INVENTORY\n\n**Note: Extract claimant''s own words from forms - do not interpret**\n\n| **Alleged Condition** | **Source** |\n|-----------------------|------------|', '| No alleged impairments documented | N/A |'),
    (3, '## SECTION 4: MEDICALLY DETERMINABLE IMPAIRMENTS\n\n| **Confirmed Diagnosis** | **ICD Code** | **Severity** | **First Documented** | **Source** |\n|-------------------------|--------------|--------------|----------------------|------------|', '| No MDIs documented | N/A | N/A | N/A | N/A |'),
    (4, '## SECTION 5: MEDICAL SOURCE OPINIONS\n\n| **Date** | **Medical Source** | **Relationship** | **Opinion Type** | **Source** |\n|----------|--------------------|------------------|------------------|------------|', '| N/A | No medical source opinions documented | N/A | N/A | N/A |'),
    (5, '## SECTION 6: SURGICAL HISTORY INVENTORY\n\n| **Date** | **Procedure** | **Facility Type** | **Source** |\n|----------|---------------|-------------------|------------|', '| N/A | No surgical history documented | N/A | N/A |'),
    (6, '## SECTION 7: DIAGNOSTIC TESTING SUMMARY\n\n| **Date** | **Test** | **Category** | **Results (Succinct)** | **Source** |\n|----------|----------|--------------|------------------------|------------|', '| N/A | No diagnostic tests documented | N/A | N/A | N/A |'),
    (7, '## SECTION 8: CURRENT MEDICATION PROFILE\n\n| **Medication** | **Dosage** | **Frequency** | **Indication** | **Source** |\n|----------------|------------|---------------|----------------|------------|', '| No medications documented | N/A | N/A | N/A | N/A |'),
    (8, '## SECTION 9: OCCUPATIONAL HISTORY PROFILE\n\n| **Position Title** | **Employment Period** | **Exertional Level** | **Source** |\n|--------------------|-----------------------|----------------------|------------|', '| No occupational history documented | N/A | N/A | N/A |'),
    (9, '## SECTION 10: FUNCTIONAL CAPACITY INDICATORS\n\n**Note: Claimant statements only - extract from Section E forms**\n\n| **Activity Domain** | **Reported Limitation** | **Specific Examples** | **Source** |\n|---------------------|-------------------------|-----------------------|------------|', '| No functional limitations documented | N/A | N/A | N/A |'),
    (10, '## SECTION 11: MISSING MEDICAL EVIDENCE\n', 'No significant gaps in medical evidence identified.'),
    (11, '## SECTION 12: COMPREHENSIVE PATIENT HISTORY MEDICAL EVIDENCE TABLE\n\n| **DOS** | **Provider** | **Facility** | **Occurrence/Treatment** | **Source** |\n|---------|--------------|--------------|--------------------------|------------|', '| N/A | No medical events documented | N/A | N/A | N/A |')
"""
_SSN = "CASE WHEN coalesce(ssn, '') = '' THEN 'N/A' WHEN length(replace(replace(ssn, '-', ''), ' ', '')) >= 4 THEN 'XXX-XX-' || right(replace(replace(ssn, '-', ''), ' ', ''), 4) ELSE '' END"
_LINES = f"""WITH c AS (SELECT DISTINCT claimant_id, case_id, full_name, ssn, date_of_birth, bnc_code, case_file_reference, total_document_pages FROM claimants),
    x AS (SELECT DISTINCT diagnosis_id, case_id, diagnosis, icd_code, first_diagnosed, provider FROM diagnoses), v AS (SELECT *, {_DAY} AS day FROM {EVENTS}),
    h(section, head, nothing) AS (VALUES {_HEADS}),
    days AS (SELECT DISTINCT case_id, day AS a FROM v WHERE day IS NOT NULL), gaps AS (SELECT *, lead(a) OVER (PARTITION BY case_id ORDER BY a) AS b FROM days),
    r AS (
        SELECT case_id, 0 AS section, claimant_id * 3 AS place, {_sql_line("'**Full Name**'", 'full_name', "'**SSN**'", _SSN)} AS line FROM c
        UNION ALL SELECT case_id, 0, claimant_id * 3 + 1, {_sql_line("'**Date of Birth**'", _US.format(c='date_of_birth'), "'**BNC Code**'", "coalesce(nullif(bnc_code, ''), 'N/A')")} FROM c
        UNION ALL SELECT case_id, 0, claimant_id * 3 + 2, {_sql_line("'**Case File Reference**'", 'case_file_reference', "'**Total Document Pages**'", 'total_document_pages::VARCHAR')} FROM c
        UNION ALL SELECT case_id, 3, diagnosis_id, {_sql_line('diagnosis', "coalesce(nullif(icd_code, ''), 'N/A')", "'N/A'", f"coalesce({_US.format(c='first_diagnosed')}, 'N/A')", 'provider')} FROM x
        UNION ALL SELECT case_id, 4, event_id, {_sql_line(_US.format(c='day'), 'provider', "'treating'", "'statement'", 'exhibit_reference')} FROM v WHERE event_type = 'medical_source_statement'
        UNION ALL SELECT case_id, 5, event_id, {_sql_line(_US.format(c='day'), 'description', 'location', 'exhibit_reference')} FROM v WHERE event_type = 'surgical_report'
        UNION ALL SELECT case_id, 6, event_id, {_sql_line(_US.format(c='day'), 'description', "'N/A'", "'see text'", 'exhibit_reference')} FROM v WHERE event_type = 'diagnostic_study'
        UNION ALL SELECT case_id, 10, a - DATE '1970-01-01', '- ' || (b - a) || ' days without treatment (' || {_US.format(c='a')} || ' - ' || {_US.format(c='b')} || ')' FROM gaps WHERE b - a >= 365
        UNION ALL SELECT case_id, 11, (date - DATE '1970-01-01')::BIGINT * 4294967296 + seq, {_sql_line(_US.format(c='date'), 'provider', 'facility', "coalesce(nullif(occurrence, ''), '—')", 'source')} FROM ({_CHRON})),
    f AS (SELECT DISTINCT case_id, h.* FROM claimants, h)"""


@query(
    f"""{_LINES} SELECT case_id, section, -2::BIGINT AS place, head AS line FROM f UNION ALL SELECT case_id, section, -1, nothing FROM f WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.case_id = f.case_id AND r.section = f.section)
    UNION ALL SELECT case_id, section, place::BIGINT, line FROM r"""
)
def report_lines(spark: SparkSession, d: str) -> DataFrame:
    return _reported(spark, d).lines()


@query(
    f"""{_LINES} SELECT f.case_id, f.section, count(r.line)::INT AS lines, md5(head || chr(10) || coalesce(string_agg(line, chr(10) ORDER BY place, line), any_value(nothing))) AS markdown_md5
    FROM f LEFT JOIN r ON r.case_id = f.case_id AND r.section = f.section GROUP BY f.case_id, f.section, head"""
)
def report_sections(spark: SparkSession, d: str) -> DataFrame:
    return _reported(spark, d).sections().select("case_id", "section", "lines", F.md5("markdown").alias("markdown_md5"))


@query(
    f"""SELECT event_id, '### ' || coalesce(date, 'Unknown Date') || chr(10) || CASE WHEN coalesce(event_type, '') <> '' THEN chr(10) || '**' || event_type || '**' || chr(10) ELSE '' END
        || CASE WHEN coalesce(provider, '') <> '' OR coalesce(location, '') <> '' THEN chr(10) || concat_ws(' - ', nullif(provider, ''), nullif(location, '')) || chr(10) ELSE '' END
        || CASE WHEN coalesce(exhibit_reference, '') <> '' THEN chr(10) || '**Source:** ' || exhibit_reference || chr(10) ELSE '' END || CASE WHEN coalesce(description, '') <> '' THEN chr(10) || description || chr(10) ELSE '' END AS block FROM {EVENTS}"""
)
def entry_blocks(spark: SparkSession, d: str) -> DataFrame:
    rows = event_rows(spark, d, "date", "event_type", "provider", "location", "exhibit_reference", "description")
    return rows.select("event_id", report.entry_block(*map(F.col, ("date", "event_type", "provider", "location", "exhibit_reference", "description"))).alias("block"))
