"""Queries over the operators on bookmarks, citations, entries and chronologies, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.functions import citations as cite
from chartloom.functions import dates, text
from chartloom.operators import chronology, chunks, citations, entries, longitudinal, occurrences, repair, segments
from chartloom.plans import chronology as plan
from chartloom.queries import query
from chartloom.session import table
from chartloom.sources import jobs
from chartloom.sources.providers import RuleProvider
from chartloom.streaming import events as stream_events

# Rows that were delivered again are one record.
TOC = "(SELECT DISTINCT bookmark_id, case_id, ord, level, title, page_start, page_end FROM toc)"
EVENTS = "(SELECT DISTINCT event_id, case_id, event_type, date, provider, location, description, diagnosis, severity, confidence, source_page, source_text, exhibit_reference FROM medical_events)"
DX = "(SELECT DISTINCT diagnosis_id, case_id, diagnosis, icd_code FROM diagnoses)"
CLAIMANTS = "(SELECT DISTINCT claimant_id, case_id, total_document_pages, ssn FROM claimants)"


def toc_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "toc").select("bookmark_id", "case_id", "ord", "level", "title", "page_start", "page_end").distinct()


def event_rows(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The columns that a query needs, once a record: others would ride along through the shuffle."""
    return table(spark, d, "medical_events").select("event_id", *columns).distinct()


def exhibit_ranges(spark: SparkSession, d: str) -> DataFrame:
    rows = toc_rows(spark, d).withColumn("exhibit_id", F.regexp_extract("title", r"^(\d+[A-F])", 1))
    return rows.select("case_id", "ord", "exhibit_id", F.col("page_start").alias("start_page"), F.col("page_end").alias("end_page"))


RANGES = f"(SELECT case_id, ord, regexp_extract(title, '^(\\d+[A-F])', 1) AS ex, page_start AS s, page_end AS e FROM {TOC} WHERE regexp_matches(title, '^\\d+[A-F]') AND page_start > 0 AND page_end >= page_start)"


def resolved_sql(page: str) -> str:
    return f"""SELECT v.event_id, {page} AS page, arg_max(r.ex, r.ord) AS ex, CAST({page} - arg_max(r.s, r.ord) + 1 AS INT) AS rel
        FROM {EVENTS} v LEFT JOIN {RANGES} r ON v.case_id = r.case_id AND {page} BETWEEN r.s AND r.e WHERE v.source_page IS NOT NULL GROUP BY v.event_id, {page}"""


def _stamps_sql(c: str) -> str:
    for p in text.COURT_STAMPS:
        c = f"regexp_replace({c}, '(?i){p}', '', 'g')"
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


# ---------------------------------------------------------------- bookmarks


@query(
    f"""SELECT bookmark_id, CASE WHEN regexp_matches(title, '^\\d+[A-F]') THEN regexp_extract(title, '^(\\d+[A-F])', 1) ELSE left(title, 10) END AS exhibit_id, regexp_matches(title, '^\\d+F') AS is_medical
    FROM {TOC} WHERE regexp_matches(title, '(?i)\\d+[A-F]\\s*[-:]|Exhibit\\s+[A-Z0-9]+|Ex\\.\\s*[A-Z0-9]+|Attachment\\s+[A-Z0-9]+|Appendix\\s+[A-Z0-9]+|Tab\\s+[A-Z0-9]+')"""
)
def exhibit_titles(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("title")
    return toc_rows(spark, d).where(segments.is_exhibit(t)).select("bookmark_id", segments.exhibit_id(t).alias("exhibit_id"), segments.is_medical(t).alias("is_medical"))


@query(
    f"SELECT bookmark_id, CASE {' '.join(f"WHEN regexp_matches(title, '(?i){p}') THEN '{s}'" for s, p in segments.SECTION_TITLES.items())} END AS section FROM {TOC} WHERE regexp_matches(title, '(?i){'|'.join(segments.SECTION_TITLES.values())}')"
)
def section_titles(spark: SparkSession, d: str) -> DataFrame:
    return toc_rows(spark, d).select("bookmark_id", segments.section_of(F.col("title")).alias("section")).where("section IS NOT NULL")


@query(f"SELECT section_id, count(*) AS exhibits FROM (SELECT CASE WHEN upper(right(ex, 1)) BETWEEN 'A' AND 'Z' THEN upper(right(ex, 1)) ELSE '' END AS section_id FROM (SELECT regexp_extract(title, '^(\\d+[A-F])', 1) AS ex FROM {TOC} WHERE regexp_matches(title, '^\\d+[A-F]'))) GROUP BY section_id")
def section_counts(spark: SparkSession, d: str) -> DataFrame:
    found = toc_rows(spark, d).select(F.regexp_extract("title", r"^(\d+[A-F])", 1).alias("ex")).where("ex <> ''")
    return found.groupBy(segments.section_id(F.col("ex")).alias("section_id")).agg(F.count("*").alias("exhibits"))


@query(
    f"""WITH t AS (SELECT b.*, c.total FROM {TOC} b LEFT JOIN (SELECT case_id, max(total_document_pages) AS total FROM claimants GROUP BY case_id) c USING (case_id) WHERE page_start IS NOT NULL)
    SELECT bookmark_id, greatest(coalesce((SELECT arg_min(n.page_start, n.ord) FROM t n WHERE n.case_id = t.case_id AND n.ord > t.ord AND n.level <= t.level) - 1, total), page_start) AS page_end FROM t"""
)
def bookmark_end_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "claimants").groupBy("case_id").agg(F.max("total_document_pages").alias("total_pages"))
    rows = toc_rows(spark, d).where("page_start IS NOT NULL").drop("page_end").join(pages, "case_id", "left")
    return segments.end_pages(rows).select("bookmark_id", "page_end")


@query(
    f"""WITH f AS (SELECT t.case_id, ord, regexp_extract(title, '^C?(\\d+F)\\s*[-:]', 1) AS exhibit_id, page_start, total FROM {TOC} t LEFT JOIN (SELECT case_id, max(total_document_pages) AS total FROM claimants GROUP BY case_id) c USING (case_id)
        WHERE regexp_matches(title, '^C?\\d+F\\s*[-:]') AND page_start IS NOT NULL),
    g AS (SELECT *, coalesce(lead(page_start) OVER (PARTITION BY case_id ORDER BY ord) - 1, total) AS end_page FROM f)
    SELECT case_id, ord, exhibit_id, page_start, end_page, least(greatest(end_page - page_start + 1, 0), 50) AS pages_read, page_start + least(greatest(end_page - page_start + 1, 0), 50) - 1 AS last_read FROM g"""
)
def medical_exhibits(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "claimants").groupBy("case_id").agg(F.max("total_document_pages").alias("total_pages"))
    rows = toc_rows(spark, d).where("page_start IS NOT NULL").join(pages, "case_id", "left")
    return segments.f_exhibits(rows, F.col("total_pages"))


@query(f"SELECT case_id, count(*) AS bookmarks, max(level) AS max_depth, count(*) FILTER (WHERE level = 1) AS roots FROM {TOC} GROUP BY case_id")
def bookmark_structure(spark: SparkSession, d: str) -> DataFrame:
    return segments.structure(toc_rows(spark, d))


@query(
    f"""WITH r AS (SELECT case_id, level, lower(coalesce(title, '')) AS t, row_number() OVER (PARTITION BY case_id ORDER BY ord) AS n, row_number() OVER (PARTITION BY case_id, level ORDER BY ord) AS k FROM {TOC}),
    g AS (SELECT case_id, bool_or(n <= 5 AND (contains(t, 'certification') OR (contains(t, 'court') AND contains(t, 'index')))) AS court, count(*) FILTER (WHERE level = 2 AND regexp_matches(t, '^c\\d+[a-f]\\s*-')) AS c,
        bool_or(n = 1 AND t = 'table of contents') AS toc1, count(*) FILTER (WHERE level = 3 AND k <= 20 AND regexp_matches(t, '^\\(page\\s+\\d+\\s+of\\s+\\d+\\)')) AS p FROM r GROUP BY case_id)
    SELECT case_id, CASE WHEN court OR c >= 3 THEN 'court_transcript' WHEN toc1 OR p >= 3 THEN 'processed' ELSE 'raw_ssa' END AS format FROM g"""
)
def file_formats(spark: SparkSession, d: str) -> DataFrame:
    return segments.file_format(toc_rows(spark, d))


_SCANNED = f"(event_id % 3 > 0 AND (length(trim(coalesce(source_text, ''), ' ' || chr(9) || chr(10) || chr(13))) <= 150 OR length({{stamps}}) < 100))"


def page_images(spark: SparkSession, d: str) -> DataFrame:
    """Source texts as pages; two of three hold a large image."""
    rows = event_rows(spark, d, "case_id", "source_text")
    return rows.select("event_id", "case_id", segments.is_scanned(F.col("source_text"), F.col("event_id") % 3 > 0).alias("scanned"))


@query(f"SELECT event_id, {_SCANNED.format(stamps=_stamps_sql("coalesce(source_text, '')"))} AS scanned FROM {EVENTS}")
def page_scans(spark: SparkSession, d: str) -> DataFrame:
    return page_images(spark, d).select("event_id", "scanned")


@query(
    f"""SELECT case_id, count(*) FILTER (WHERE scanned) AS scanned_pages, count(*) AS sampled_pages, count(*) FILTER (WHERE scanned) / count(*) AS scanned_ratio,
        CASE WHEN count(*) FILTER (WHERE scanned) / count(*) > 0.5 THEN 'vision' WHEN count(*) FILTER (WHERE scanned) / count(*) > 0.1 THEN 'hybrid' ELSE 'text' END AS recommendation
    FROM (SELECT case_id, {_SCANNED.format(stamps=_stamps_sql("coalesce(source_text, '')"))} AS scanned, row_number() OVER (PARTITION BY case_id ORDER BY event_id) AS n FROM {EVENTS}) WHERE n <= 20 GROUP BY case_id"""
)
def scan_density(spark: SparkSession, d: str) -> DataFrame:
    return segments.needs_vision(page_images(spark, d), "case_id", "scanned", "event_id")


@query("SELECT source, n // 10 AS batch, min(doc_id) AS first, max(doc_id) AS last, count(*) AS rows_in_batch FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents) GROUP BY source, n // 10")
def image_batches(spark: SparkSession, d: str) -> DataFrame:
    return segments.batches(table(spark, d, "documents").select("source", "doc_id"), ["source"], "doc_id")


# ---------------------------------------------------------------- citations


@query(f"SELECT event_id, CASE WHEN ex IS NULL THEN 'p.' || page ELSE 'Ex. ' || ex || '@' || rel || ' (p.' || page || ')' END AS citation FROM ({resolved_sql('v.source_page')})")
def citation_resolve(spark: SparkSession, d: str) -> DataFrame:
    rows = event_rows(spark, d, "case_id", "source_page").where("source_page IS NOT NULL")
    found = citations.resolve(rows, citations.page_index(exhibit_ranges(spark, d), ["case_id"], rows, "source_page"), ["case_id"], "source_page")
    return found.select("event_id", cite.resolved(F.col("exhibit_id"), F.col("relative_page"), F.col("source_page")).alias("citation"))


@query(
    f"""SELECT event_id, CASE WHEN a.ex IS NOT NULL AND a.ex = b.ex THEN 'Ex. ' || a.ex || '@' || a.rel || '-' || b.rel || ' (pp.' || a.page || '-' || b.page || ')' ELSE 'pp.' || a.page || '-' || b.page END AS citation
    FROM ({resolved_sql('v.source_page')}) a JOIN ({resolved_sql('(v.source_page + 3)')}) b USING (event_id)"""
)
def citation_format_range(spark: SparkSession, d: str) -> DataFrame:
    rows = event_rows(spark, d, "case_id", "source_page").where("source_page IS NOT NULL").withColumn("end_page", F.col("source_page") + 3)
    index = citations.page_index(exhibit_ranges(spark, d), ["case_id"], rows, "source_page", "end_page")
    both = citations.resolve(citations.resolve(rows, index, ["case_id"], "source_page"), index, ["case_id"], "end_page", "end_")
    return both.select("event_id", cite.resolved_range(*map(F.col, ("exhibit_id", "relative_page", "source_page", "end_exhibit_id", "end_relative_page", "end_page"))).alias("citation"))


@query(
    f"""SELECT event_id, CASE WHEN ex IS NULL THEN 'p.' || page ELSE ex || '@~' || rel || ' (p.' || page || ')' END AS full_style, CASE WHEN ex IS NULL THEN 'p.' || page ELSE 'Ex. ' || ex || '@~' || rel END AS exhibit_style, 'p.' || page AS absolute_style
    FROM ({resolved_sql('v.source_page')})"""
)
def citation_styles(spark: SparkSession, d: str) -> DataFrame:
    rows = event_rows(spark, d, "case_id", "source_page").where("source_page IS NOT NULL")
    found = citations.resolve(rows, citations.page_index(exhibit_ranges(spark, d), ["case_id"], rows, "source_page"), ["case_id"], "source_page")
    none = F.lit(None).cast("int")
    style = lambda s: cite.citation(F.col("source_page"), F.col("exhibit_id"), F.col("relative_page"), none, none, F.lit(True), style=s).alias(f"{s}_style")
    return found.select("event_id", style("full"), style("exhibit"), style("absolute"))


def exhibit_pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents of an exhibit as its pages, in the order of their ids."""
    from pyspark.sql import Window

    docs = table(spark, d, "documents").where("case_id IS NOT NULL AND exhibit_id IS NOT NULL").select("doc_id", "case_id", "exhibit_id", "text")
    return docs.withColumn("absolute_page", F.row_number().over(Window.partitionBy("case_id", "exhibit_id").orderBy("doc_id")))


_NORM = r"trim(regexp_replace(regexp_replace(lower({c}), '[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}\x{{200c}}\x{{200d}}\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_SKIP = ", ".join(f"'{s}'" for s in citations.SKIPPED)


@query(
    f"""WITH p AS (SELECT case_id, exhibit_id, row_number() OVER (PARTITION BY case_id, exhibit_id ORDER BY doc_id) AS page, lower(text) AS low, {_NORM.format(c='text')} AS norm FROM documents WHERE case_id IS NOT NULL AND exhibit_id IS NOT NULL),
    v AS (SELECT event_id, case_id, regexp_extract(exhibit_reference, '(\\d+F)', 1) AS exhibit_id, date, provider, location, diagnosis FROM {EVENTS} WHERE regexp_matches(exhibit_reference, '\\d+F')),
    t AS (SELECT event_id, case_id, exhibit_id, lower(trim(date)) AS x, 3.0 AS w, false AS fuzzy FROM v WHERE lower(trim(date)) NOT IN ({_SKIP})
        UNION ALL SELECT event_id, case_id, exhibit_id, {_NORM.format(c='provider')}, 2.0, true FROM v WHERE lower(provider) NOT IN ({_SKIP})
        UNION ALL SELECT event_id, case_id, exhibit_id, {_NORM.format(c='location')}, 2.0, true FROM v WHERE lower(location) NOT IN ({_SKIP})
        UNION ALL SELECT event_id, case_id, exhibit_id, {_NORM.format(c='diagnosis')}, 1.0, true FROM v WHERE length(diagnosis) > 3 AND lower(diagnosis) NOT IN ({_SKIP})),
    s AS (SELECT event_id, page, sum(w) AS score FROM t JOIN p USING (case_id, exhibit_id) WHERE CASE WHEN fuzzy THEN contains(norm, x) ELSE contains(low, x) END GROUP BY event_id, page),
    b AS (SELECT event_id, arg_max(page, {{'s': score, 'p': -page}}) AS page, max(score) AS score FROM s WHERE score >= 3 GROUP BY event_id),
    n AS (SELECT b.*, (SELECT score FROM s WHERE s.event_id = b.event_id AND s.page = b.page - 1) AS before, (SELECT score FROM s WHERE s.event_id = b.event_id AND s.page = b.page + 1) AS after FROM b),
    f AS (SELECT case_id, exhibit_id, min(page) AS page FROM p GROUP BY case_id, exhibit_id)
    SELECT v.event_id, coalesce(CASE WHEN before >= 2.1 THEN n.page - 1 ELSE n.page END, f.page)::INT AS absolute_page,
        (CASE WHEN after >= 2.1 THEN n.page + 1 WHEN before >= 2.1 THEN n.page END)::INT AS end_absolute_page, coalesce(score, 0)::DOUBLE AS match_score,
        CASE WHEN score IS NULL THEN 'fallback' ELSE 'search' END AS match_method, score IS NULL AS is_estimated
    FROM v JOIN f USING (case_id, exhibit_id) LEFT JOIN n USING (event_id)"""
)
def citation_match(spark: SparkSession, d: str) -> DataFrame:
    rows = event_rows(spark, d, "case_id", "exhibit_reference", "date", "provider", "location", "diagnosis").withColumn("exhibit_id", F.regexp_extract("exhibit_reference", r"(\d+F)", 1)).where("exhibit_id <> ''")
    terms = citations.search_terms(F.col("date"), F.col("provider"), F.col("location"), F.array("diagnosis"))
    found = rows.select(F.col("event_id").alias("entry_id"), "case_id", "exhibit_id", terms.alias("terms"))
    matched = citations.match_pages(found, exhibit_pages(spark, d), ["case_id", "exhibit_id"])
    return matched.select(F.col("entry_id").alias("event_id"), "absolute_page", "end_absolute_page", "match_score", "match_method", "is_estimated")


_B, _S = r"(?i)(\d+F)\s*[-–—]\s*(\d+)\s*of\s*(\d+)", r"(?is)EXHIBIT\s*NO\.?\s*(\d+F).*?PAGE:?\s*(\d+)\s*(?:OF\s*(\d+))?"
_A, _T = r"\b([A-Z]{2,5}\d{6,9})\b", r"(?i)Page\s+(\d+)(?:\s+of\s+(\d+))?"


@query(
    f"""WITH h AS (SELECT event_id, nullif(regexp_extract(exhibit_reference, '(\\d+F)', 1), '') AS ex, coalesce(left(source_text, 500), '') AS t, coalesce(source_text, '') AS w FROM {EVENTS}),
    k AS (SELECT *, CASE WHEN regexp_matches(t, '{_B}') THEN 'bar' WHEN regexp_matches(w, '{_S}') THEN 'stamp' WHEN regexp_matches(t, '{_A}') THEN 'bates' WHEN regexp_matches(t, '{_T}') THEN 'transcript' ELSE 'fallback' END AS kind FROM h)
    SELECT event_id, CASE kind WHEN 'bar' THEN 'ere' WHEN 'stamp' THEN 'ere' WHEN 'fallback' THEN 'generic' ELSE kind END AS source_type,
        CASE kind WHEN 'bar' THEN upper(regexp_extract(t, '{_B}', 1)) WHEN 'stamp' THEN upper(regexp_extract(w, '{_S}', 1)) WHEN 'fallback' THEN ex END AS exhibit_id,
        try_cast(CASE kind WHEN 'bar' THEN regexp_extract(t, '{_B}', 2) WHEN 'stamp' THEN regexp_extract(w, '{_S}', 2) WHEN 'transcript' THEN regexp_extract(t, '{_T}', 1) END AS INT) AS relative_page,
        try_cast(CASE kind WHEN 'bar' THEN regexp_extract(t, '{_B}', 3) WHEN 'stamp' THEN regexp_extract(w, '{_S}', 3) WHEN 'transcript' THEN regexp_extract(t, '{_T}', 2) END AS INT) AS total_pages,
        CASE kind WHEN 'bates' THEN regexp_extract(t, '{_A}', 1) END AS bates_number,
        (CASE kind WHEN 'bar' THEN 0.95 WHEN 'stamp' THEN 0.9 WHEN 'bates' THEN 0.85 WHEN 'transcript' THEN 0.8 ELSE 0.25 END)::DOUBLE AS confidence
    FROM k"""
)
def header_detect(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("int")
    rows = event_rows(spark, d, "source_text", "exhibit_reference")
    found = citations.header(F.col("source_text"), none, F.nullif(F.regexp_extract("exhibit_reference", r"(\d+F)", 1), F.lit("")), none, none)
    return rows.select("event_id", found.alias("h")).select("event_id", "h.source_type", "h.exhibit_id", "h.relative_page", "h.total_pages", "h.bates_number", "h.confidence")


@query(
    """SELECT case_id, exhibit_id, md5(string_agg('[PAGE ' || page || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY page)) AS combined_md5, count(*) AS pages
    FROM (SELECT case_id, exhibit_id, text, row_number() OVER (PARTITION BY case_id, exhibit_id ORDER BY doc_id) AS page FROM documents WHERE case_id IS NOT NULL AND exhibit_id IS NOT NULL) WHERE text IS NOT NULL GROUP BY case_id, exhibit_id"""
)
def combined_text(spark: SparkSession, d: str) -> DataFrame:
    pages = exhibit_pages(spark, d).withColumn("confidence", F.lit(0.5))
    return citations.combined_text(pages, ["case_id", "exhibit_id"]).select("case_id", "exhibit_id", F.md5("combined_text").alias("combined_md5"), "pages")


@query(
    f"""WITH x AS (SELECT case_id, regexp_extract(title, '^(\\d+F)', 1) AS ex, min(page_start) AS a, max(page_end) AS b FROM {TOC} WHERE regexp_matches(title, '^\\d+F') GROUP BY case_id, ex)
    SELECT event_id, coalesce(source_page, a) AS absolute_page, CASE WHEN source_page IS NULL THEN b END AS end_absolute_page, source_page IS NULL AND a IS NOT NULL AS is_estimated
    FROM {EVENTS} v LEFT JOIN x ON v.case_id = x.case_id AND nullif(regexp_extract(v.exhibit_reference, '(\\d+F)', 1), '') = x.ex"""
)
def citation_fallback(spark: SparkSession, d: str) -> DataFrame:
    bounds = exhibit_ranges(spark, d).where(F.col("exhibit_id").endswith("F")).groupBy("case_id", "exhibit_id").agg(F.min("start_page").alias("page_start"), F.max("end_page").alias("page_end"))
    rows = event_rows(spark, d, "case_id", "exhibit_reference", "source_page").withColumns({"exhibit_id": F.nullif(F.regexp_extract("exhibit_reference", r"(\d+F)", 1), F.lit("")), "absolute_page": F.col("source_page")})
    return citations.with_fallback(rows, bounds, ["case_id", "exhibit_id"]).select("event_id", "absolute_page", "end_absolute_page", "is_estimated")


# ---------------------------------------------------------------- entries


@query(
    "SELECT doc_id, array_to_string(list_sort(list_filter(["
    + ", ".join(f"CASE WHEN {' OR '.join(f"contains(lower(coalesce(text, '''')), '{w}')".replace("''''", "''") for w in ws)} THEN '{k}' END" for k, ws in entries.VISIT_WORDS.items())
    + ", 'office_visit'], lambda x: x IS NOT NULL)), ',') AS visit_types FROM documents"
)
def visit_type_detect(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(entries.visit_types_of(F.col("text")), ",").alias("visit_types"))


@query(
    f"""SELECT event_id, date, coalesce(provider, 'Not Specified') AS provider, coalesce(location, 'Not Specified') AS facility, coalesce(exhibit_reference, 'none') AS exhibit_reference,
        CASE WHEN event_type IN ({', '.join(f"'{v}'" for v in entries.VISIT_TYPES)}) THEN event_type ELSE 'office_visit' END AS visit_type FROM {EVENTS} WHERE trim(date) <> ''"""
)
def entry_validate(spark: SparkSession, d: str) -> DataFrame:
    rows = event_rows(spark, d, "date", "provider", "location", "exhibit_reference", "event_type")
    members = F.to_json(F.struct("date", "provider", F.col("location").alias("facility"), "exhibit_reference", F.col("event_type").alias("visit_type")))
    found = entries.validated(rows.select("event_id", F.lit("none").alias("default_exhibit"), F.from_json(members, "map<string,string>").alias("entry")), "default_exhibit")
    return found.select("event_id", "date", "provider", "facility", "exhibit_reference", "visit_type")


@query(f"SELECT event_id FROM {EVENTS} WHERE coalesce(event_type, '') = '' OR NOT (coalesce(length(trim(diagnosis)), 0) > 22 OR coalesce(length(trim(severity)), 0) > 10)")
def sparse_entries(spark: SparkSession, d: str) -> DataFrame:
    rows = event_rows(spark, d, "event_type", "diagnosis", "severity")
    occurrence = F.from_json(F.to_json(F.struct(F.substring("diagnosis", 13, 100).alias("assessment"), F.col("severity").alias("findings"))), "map<string,string>")
    return rows.where(entries.is_sparse(F.col("event_type"), occurrence)).select("event_id")


@query(
    f"""SELECT event_id, CASE WHEN chunk > 0 THEN chunk END::BIGINT AS from_chunk FROM (SELECT event_id, event_id % 4 AS chunk, row_number() OVER (PARTITION BY case_id, coalesce(date, ''), coalesce(event_type, ''), left(replace(lower(coalesce(provider, '')), ' ', ''), 20) ORDER BY event_id % 4, event_id) AS n FROM {EVENTS}) WHERE n = 1"""
)
def chunk_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = event_rows(spark, d, "case_id", "date", "event_type", "provider").select("event_id", "case_id", "date", F.col("event_type").alias("visit_type"), "provider", F.col("event_id").alias("seq"), (F.col("event_id") % 4).alias("chunk_index"), F.lit(4).alias("total_chunks"))
    return entries.merged_chunks(rows, ["case_id"]).select("event_id", "from_chunk")


_RICH = "case_id, date, event_type"


@query(f"SELECT event_id, first_seq FROM (SELECT event_id, min(event_id) OVER (PARTITION BY {_RICH}) AS first_seq, row_number() OVER (PARTITION BY {_RICH} ORDER BY severity IS NULL, event_id) AS n FROM {EVENTS}) WHERE n = 1")
def richest_dedupe(spark: SparkSession, d: str) -> DataFrame:
    rows = event_rows(spark, d, "case_id", "date", "event_type", "severity").withColumns({"sparse": F.col("severity").isNull(), "seq": F.col("event_id")})
    return entries.richest(rows, ["case_id", "date", "event_type"]).select("event_id", "first_seq")


@query(
    f"""WITH e AS (SELECT event_id AS seq, case_id, date, event_type, severity IS NULL AS sparse, description AS occurrence FROM {EVENTS}),
    l AS (SELECT * FROM e WHERE seq % 2 = 0), r AS (SELECT * FROM e WHERE seq % 2 = 1),
    f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_RICH} ORDER BY seq) AS n FROM r) WHERE n = 1),
    a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_RICH} ORDER BY seq) AS n FROM r WHERE NOT sparse) WHERE n = 1)
    SELECT l.seq, CASE WHEN l.sparse AND NOT coalesce(f.sparse, true) THEN f.occurrence ELSE l.occurrence END AS occurrence, l.sparse AND NOT coalesce(f.sparse, true) AS enriched
    FROM l LEFT JOIN f ON l.case_id IS NOT DISTINCT FROM f.case_id AND l.date IS NOT DISTINCT FROM f.date AND l.event_type IS NOT DISTINCT FROM f.event_type
    UNION ALL SELECT a.seq, a.occurrence, true FROM a WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.case_id IS NOT DISTINCT FROM a.case_id AND l.date IS NOT DISTINCT FROM a.date AND l.event_type IS NOT DISTINCT FROM a.event_type)"""
)
def recover_entries(spark: SparkSession, d: str) -> DataFrame:
    rows = event_rows(spark, d, "case_id", "date", "event_type", "severity", "description").select(F.col("event_id").alias("seq"), "case_id", "date", "event_type", F.col("severity").isNull().alias("sparse"), F.col("description").alias("occurrence"))
    return entries.recovered(rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1"), ["case_id", "date", "event_type"]).select("seq", "occurrence", "enriched")


@query(
    f"""WITH l AS (SELECT case_id, event_type, event_id AS seq, row_number() OVER (PARTITION BY case_id, event_type ORDER BY event_id) AS n FROM {EVENTS} WHERE event_id % 2 = 0 AND event_type IS NOT NULL),
    r AS (SELECT case_id, event_type, event_id AS seq, row_number() OVER (PARTITION BY case_id, event_type ORDER BY event_id) AS n FROM {EVENTS} WHERE event_id % 2 = 1 AND event_type IS NOT NULL)
    SELECT case_id, event_type, l.seq AS sparse_seq, r.seq AS retry_seq, CASE WHEN l.seq IS NULL THEN 'appended' WHEN r.seq IS NULL THEN 'leftover' ELSE 'filled' END AS outcome FROM l FULL JOIN r USING (case_id, event_type, n)"""
)
def consuming_match(spark: SparkSession, d: str) -> DataFrame:
    rows = event_rows(spark, d, "case_id", "event_type").where("event_type IS NOT NULL").withColumnRenamed("event_id", "seq")
    return entries.consumed(rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1"), ["case_id", "event_type"])


# ---------------------------------------------------------------- chronology


_DAY = """CASE WHEN regexp_matches(date, '^\\d{4}-\\d{1,2}-\\d{1,2}$') THEN try_strptime(date, '%Y-%m-%d') WHEN regexp_matches(date, '^\\d{1,2}/\\d{1,2}/\\d{4}$') THEN try_strptime(date, '%m/%d/%Y') WHEN regexp_matches(date, '^\\d{1,2}-\\d{1,2}-\\d{4}$') THEN try_strptime(date, '%m-%d-%Y') END::DATE"""
_CHRON = f"""SELECT event_id AS seq, case_id, {_DAY} AS date, coalesce(provider, 'Unknown') AS provider, coalesce(location, 'Unknown') AS facility, CASE WHEN event_type = 'lab_result' THEN '**Test:** ' ELSE '' END || coalesce(description, '') AS occurrence,
    coalesce(regexp_replace(exhibit_reference, '^Ex\\. ', ''), '') AS source FROM {EVENTS} WHERE {_DAY} IS NOT NULL"""


def chronology_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = event_rows(spark, d, "case_id", "date", "provider", "location", "event_type", "description", "exhibit_reference").withColumn("date", dates.parsed(F.col("date"))).where("date IS NOT NULL")
    return rows.select(
        F.col("event_id").alias("seq"), "case_id", "date", F.coalesce("provider", F.lit("Unknown")).alias("provider"), F.coalesce("location", F.lit("Unknown")).alias("facility"),
        F.concat(F.when(F.col("event_type") == "lab_result", "**Test:** ").otherwise(""), F.coalesce("description", F.lit(""))).alias("occurrence"), F.coalesce(F.regexp_replace("exhibit_reference", r"^Ex\. ", ""), F.lit("")).alias("source"),
    )


@query(f"SELECT event_id, {_DAY} AS day FROM {EVENTS}")
def date_parse(spark: SparkSession, d: str) -> DataFrame:
    return event_rows(spark, d, "date").select("event_id", dates.parsed(F.col("date")).alias("day"))


_SOURCES = """SELECT {k}, CASE WHEN count(*) = 1 THEN max(s) WHEN count(ex) > 0 THEN string_agg(DISTINCT r, ', ' ORDER BY r) ELSE string_agg(s, ', ' ORDER BY s) END AS {into} FROM (
    SELECT {k}, s, ex, CASE WHEN ex IS NOT NULL THEN ex || '@' || min(p) OVER (PARTITION BY {k}, ex) || CASE WHEN max(p) OVER (PARTITION BY {k}, ex) > min(p) OVER (PARTITION BY {k}, ex) THEN '-' || max(p) OVER (PARTITION BY {k}, ex) ELSE '' END END AS r
    FROM (SELECT DISTINCT {k}, source AS s, nullif(regexp_extract(source, '^(\\d+F)@(\\d+)', 1), '') AS ex, try_cast(regexp_extract(source, '^(\\d+F)@(\\d+)', 2) AS BIGINT) AS p FROM {rows} WHERE source IS NOT NULL)) GROUP BY {k}"""


@query(
    f"""WITH c AS ({_CHRON}), labs AS (SELECT * FROM c WHERE contains(lower(occurrence), '**test:**')),
    t AS (SELECT case_id, date, provider, facility, min(seq) AS seq, string_agg(occurrence, '<br><br>' ORDER BY seq) AS occurrence FROM labs GROUP BY ALL),
    s AS ({_SOURCES.format(k='case_id, date, provider, facility', into='source', rows='labs')}),
    g AS (SELECT seq, case_id, date, provider, occurrence, source FROM c WHERE NOT contains(lower(occurrence), '**test:**') UNION ALL SELECT seq, case_id, date, provider, occurrence, source FROM t JOIN s USING (case_id, date, provider, facility)),
    n AS (SELECT *, row_number() OVER (PARTITION BY case_id, date, provider, left(occurrence, 100), source ORDER BY seq) AS n FROM g)
    SELECT case_id, date, seq, source, occurrence FROM n WHERE n = 1"""
)
def chronology_processed(spark: SparkSession, d: str) -> DataFrame:
    return chronology.processed(chronology_rows(spark, d), ["case_id"]).select("case_id", "date", "seq", "source", "occurrence")


@query(f"WITH c AS ({_CHRON}) " + _SOURCES.format(k="case_id", into="combined_source", rows="c"))
def source_combine(spark: SparkSession, d: str) -> DataFrame:
    return chronology.combined_sources(chronology_rows(spark, d), ["case_id"], "source")


@query(
    f"""WITH f AS (SELECT case_id, nullif(regexp_extract(exhibit_reference, '(\\d+F)', 1), '') AS exhibit_id, count(DISTINCT source_page) AS citations, min(source_page) AS a, max(source_page) AS b FROM {EVENTS} WHERE source_page IS NOT NULL GROUP BY case_id, exhibit_id)
    SELECT case_id, '- **' || CASE WHEN exhibit_id IS NULL THEN 'Other Sources' ELSE 'Exhibit ' || exhibit_id END || '**: ' || citations || ' citation(s), ' || CASE WHEN a = b THEN 'p.' || a ELSE 'pp.' || a || '-' || b END AS line,
        row_number() OVER (PARTITION BY case_id ORDER BY exhibit_id IS NULL, coalesce(try_cast(regexp_extract(exhibit_id, '^(\\d+)', 1) AS INT), 999), exhibit_id)::INT AS place FROM f"""
)
def footer_sources(spark: SparkSession, d: str) -> DataFrame:
    rows = event_rows(spark, d, "case_id", "exhibit_reference", "source_page").select("case_id", F.regexp_extract("exhibit_reference", r"(\d+F)", 1).alias("exhibit_id"), F.col("source_page").alias("absolute_page"))
    return chronology.footer(rows, ["case_id"]).select("case_id", "line", "place")


@query(
    f"""SELECT case_id, dx AS diagnosis, row_number() OVER (PARTITION BY case_id ORDER BY dx)::INT AS number FROM (SELECT DISTINCT case_id, trim(x) AS dx FROM (SELECT case_id, unnest(regexp_split_to_array(coalesce(diagnosis, '') || '; ' || coalesce(icd_code, ''), '[;,]')) AS x FROM {DX}) WHERE length(trim(x)) > 3)"""
)
def diagnoses_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "diagnoses").select("diagnosis_id", "case_id", "diagnosis", "icd_code").distinct()
    listed = F.concat(F.lit("**CC:** pain<br>**Dx:** "), F.coalesce("diagnosis", F.lit("")), F.lit("; "), F.coalesce("icd_code", F.lit("")), F.lit("<br>**Plan:** none"))
    return chronology.diagnoses(rows.select("case_id", listed.alias("occurrence")), ["case_id"], "occurrence").select("case_id", "diagnosis", "number")


@query(f"SELECT case_id, provider, arg_min(coalesce(location, ''), event_id) AS facility FROM {EVENTS} WHERE provider <> '' AND provider NOT IN ('Unknown', 'Not Specified') GROUP BY case_id, provider")
def providers_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = event_rows(spark, d, "case_id", "provider", "location").select("case_id", "provider", F.coalesce("location", F.lit("")).alias("facility"), F.col("event_id").alias("seq"))
    return chronology.providers(rows, ["case_id"])


@query(f"SELECT case_id, count(*) AS events, count(DISTINCT CASE WHEN provider <> 'Unknown' THEN provider END) AS providers FROM {EVENTS} GROUP BY case_id")
def report_counts(spark: SparkSession, d: str) -> DataFrame:
    return chronology.counts(event_rows(spark, d, "case_id", "provider"), ["case_id"])


@query(f"SELECT case_id, count(*) AS events, count({_DAY}) AS dated, CASE WHEN count({_DAY}) = 0 THEN 'No dated events' ELSE min({_DAY}) || ' to ' || max({_DAY}) END AS span FROM {EVENTS} GROUP BY case_id")
def event_statistics(spark: SparkSession, d: str) -> DataFrame:
    return chronology.date_span(event_rows(spark, d, "case_id", "date"), ["case_id"], "date")


@query(f"SELECT case_id, round((0.8 + least(1.0, count(DISTINCT nullif(provider, '')) / 5) + count(*) FILTER (WHERE coalesce(date, '') <> '') / count(*)) / 3, 9) AS confidence FROM {EVENTS} GROUP BY case_id")
def extraction_confidence(spark: SparkSession, d: str) -> DataFrame:
    return chronology.confidence(event_rows(spark, d, "case_id", "provider", "date"), ["case_id"], F.lit(0.8), "provider", "date").withColumn("confidence", F.round("confidence", 9))


@query(
    f"""SELECT event_id, array_to_string(list_filter([CASE WHEN coalesce(description, '') NOT IN ('', '0') THEN '**Chief Complaint:** ' || CASE WHEN length(description) > 300 THEN left(description, 300) || '...' ELSE description END END,
        CASE WHEN coalesce(diagnosis, '') <> '' THEN '**Assessment Dx:** ' || diagnosis END, CASE WHEN coalesce(severity, '') <> '' THEN '**Severity 3D:** ' || severity END], lambda x: x IS NOT NULL), '<br>') AS rendered FROM {EVENTS}"""
)
def occurrence_render(spark: SparkSession, d: str) -> DataFrame:
    rows = event_rows(spark, d, "event_type", "description", "diagnosis", "severity")
    occurrence = F.create_map(F.lit("visit_type"), F.col("event_type"), F.lit("chief_complaint"), F.col("description"), F.lit("assessment_dx"), F.col("diagnosis"), F.lit("severity_3d"), F.col("severity"))
    return rows.select("event_id", chronology.rendered(occurrence).alias("rendered"))


@query(
    f"""WITH c AS ({_CHRON}) SELECT case_id, length(string_agg('| ' || strftime(date, '%m/%d/%Y') || ' | ' || replace(provider, '|', '\\|') || ' | ' || replace(facility, '|', '\\|') || ' | ' || replace(occurrence, '|', '\\|') || ' | ' || replace(source, '|', '\\|') || ' |', chr(10) ORDER BY date, seq))::INT + 106 AS chars FROM c GROUP BY case_id"""
)
def markdown_report(spark: SparkSession, d: str) -> DataFrame:
    return chronology.markdown_table(chronology_rows(spark, d), ["case_id"]).select("case_id", F.length("markdown").alias("chars"))


_ESC = "replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


@query(f"WITH c AS ({_CHRON}) SELECT seq, '<tr><td>' || strftime(date, '%m/%d/%Y') || '</td><td>' || {_ESC.format(c='provider')} || '</td><td>' || {_ESC.format(c='facility')} || '</td><td>' || {_ESC.format(c='occurrence')} || '</td><td>' || {_ESC.format(c='source')} || '</td></tr>' AS html FROM c")
def html_table(spark: SparkSession, d: str) -> DataFrame:
    return chronology.html_rows(chronology_rows(spark, d)).select("seq", "html")


@query(f"SELECT claimant_id, CASE WHEN length(replace(replace(coalesce(ssn, ''), '-', ''), ' ', '')) >= 4 THEN 'XXX-XX-' || right(replace(replace(ssn, '-', ''), ' ', ''), 4) ELSE '' END AS masked FROM {CLAIMANTS}")
def ssn_mask(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "claimants").select("claimant_id", "ssn").distinct().select("claimant_id", text.masked_ssn(F.col("ssn")).alias("masked"))


@query(
    r"""SELECT o_orderkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace('Per ' || split_part(o_orderpriority, '-', 2) || ' v. ' || o_orderstatus || ' Region, ' || (o_orderkey % 900) || ' F 101 (1999), ' || (o_orderkey % 42) || ' USC § ' || (o_orderkey % 50) || '.2, and 20 C.F.R. § 404.' || o_custkey || '; 85 Fed. Reg. ' || o_orderkey,
        '(\w+(?:\s+\w+)*)\s+v\.\s+(\w+(?:\s+\w+)*),\s+(\d+)\s+(\w+(?:\s+\w+)*)\s+(\d+)\s+\((\d{4})\)', '<cite class="case-citation">\1 v. \2, \3 \4 \5 (\6)</cite>', 'gi'),
        '(\d+)\s+([A-Z]\.?[A-Z]\.?[A-Z]\.?)\s+§\s+(\d+(?:\.\d+)*)', '<cite class="statute-citation">\1 \2 § \3</cite>', 'gi'),
        '(\d+)\s+C\.F\.R\.\s+§\s+(\d+(?:\.\d+)*)', '<cite class="cfr-citation">\1 C.F.R. § \2</cite>', 'gi'),
        '(\d+)\s+Fed\.\s+Reg\.\s+(\d+)', '<cite class="fed-reg-citation">\1 Fed. Reg. \2</cite>', 'gi') AS html FROM orders"""
)
def legal_citations(spark: SparkSession, d: str) -> DataFrame:
    part = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    said = F.concat(
        F.lit("Per "), F.split_part("o_orderpriority", F.lit("-"), F.lit(2)), F.lit(" v. "), "o_orderstatus", F.lit(" Region, "), part(F.col("o_orderkey") % 900), F.lit(" F 101 (1999), "), part(F.col("o_orderkey") % 42), F.lit(" USC § "),
        part(F.col("o_orderkey") % 50), F.lit(".2, and 20 C.F.R. § 404."), part("o_custkey"), F.lit("; 85 Fed. Reg. "), part("o_orderkey"),
    )
    return table(spark, d, "orders").select("o_orderkey", text.with_legal_citations(said).alias("html"))


@query(f"SELECT event_id, {_stamps_sql('source_text')} AS clean FROM {EVENTS} WHERE source_text IS NOT NULL")
def court_stamps(spark: SparkSession, d: str) -> DataFrame:
    rows = event_rows(spark, d, "source_text").where("source_text IS NOT NULL")
    return rows.select("event_id", text.without_court_stamps(F.col("source_text")).alias("clean"))


# ---------------------------------------------------------------- model output


@query()
def response_entries(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "dde_results").select("dde_id", "result_json").distinct()
    fenced = F.when(F.col("dde_id") % 2 == 0, F.concat(F.lit("Here it is:\n```json\n"), "result_json", F.lit("\n```"))).otherwise(F.col("result_json"))
    return repair.entries(rows.select("dde_id", fenced.alias("response")), "dde_id", "response")


@query(
    """WITH r AS (SELECT DISTINCT dde_id, result_json::JSON AS j FROM dde_results WHERE json_valid(result_json) AND json_type(result_json) = 'OBJECT'),
    f AS (SELECT dde_id, j, coalesce(j->'case_metadata'->>'claimant_name', j->>'claimant_name') AS claimant_name, coalesce(j->'case_metadata'->>'alleged_onset_date', j->>'alleged_onset_date') AS alleged_onset_date,
        coalesce(j->'case_metadata'->>'age_category', j->>'age_category') AS age_category FROM r)
    SELECT dde_id, claimant_name, alleged_onset_date, age_category, round((((coalesce(j->'case_metadata'->>'claimant_name', '') <> '' OR coalesce(j->>'claimant_name', '') <> '')::INT) + ((coalesce(j->'case_metadata'->>'date_of_birth', '') <> '' OR coalesce(j->>'date_of_birth', '') <> '')::INT) + ((coalesce(j->'case_metadata'->>'claim_type', '') <> '' OR coalesce(j->>'claim_type', '') <> '')::INT) + ((coalesce(j->'case_metadata'->>'alleged_onset_date', '') <> '' OR coalesce(j->>'alleged_onset_date', '') <> '')::INT) + ((coalesce(j->'case_metadata'->>'protective_filing_date', '') <> '' OR coalesce(j->>'protective_filing_date', '') <> '')::INT)) / 5, 9) AS confidence FROM f"""
)
def dde_normalize(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "dde_results").select("dde_id", "result_json").distinct()
    return repair.normalized(rows, "dde_id", "result_json").select("dde_id", "claimant_name", "alleged_onset_date", "age_category", F.round("confidence", 9).alias("confidence"))


@query(f"SELECT event_id, CASE WHEN contains(lift, '50') THEN 'Medium' WHEN contains(lift, '20') THEN 'Light' WHEN contains(lift, '10') THEN 'Sedentary' ELSE 'Unknown' END AS capacity FROM (SELECT event_id, regexp_extract(description, 'lift (\\d+) pounds', 1) AS lift FROM {EVENTS} WHERE description IS NOT NULL)")
def exertional_capacity(spark: SparkSession, d: str) -> DataFrame:
    rows = event_rows(spark, d, "description").where("description IS NOT NULL")
    return rows.select("event_id", repair.exertional_capacity(F.regexp_extract("description", r"lift (\d+) pounds", 1)).alias("capacity"))


@query()
def extraction_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunks.chunked(table(spark, d, "documents"), "doc_id", "text", 4_000, 200, 500)


# ---------------------------------------------------------------- over time


@query(
    f"""WITH x AS (SELECT DISTINCT case_id, {_DAY} AS gap_start FROM {EVENTS} WHERE {_DAY} IS NOT NULL), l AS (SELECT *, lead(gap_start) OVER (PARTITION BY case_id ORDER BY gap_start) AS gap_end FROM x)
    SELECT case_id, gap_start, gap_end, (gap_end - gap_start)::INT AS days, CASE WHEN gap_end - gap_start >= 180 THEN 'critical' WHEN gap_end - gap_start >= 90 THEN 'significant' WHEN gap_end - gap_start >= 60 THEN 'moderate' ELSE 'minor' END AS severity FROM l WHERE gap_end - gap_start >= 30"""
)
def treatment_gaps(spark: SparkSession, d: str) -> DataFrame:
    rows = event_rows(spark, d, "case_id", "date").select("case_id", dates.parsed(F.col("date")).alias("day"))
    return longitudinal.treatment_gaps(rows, ["case_id"], "day")


@query(
    """WITH r AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id, value) AS n, count(*) OVER (PARTITION BY event_type) AS c FROM events WHERE value IS NOT NULL)
    SELECT event_type, count(*) AS readings, max(value) AS peak, arg_max(event_id, {'v': value, 'n': -n}) AS peak_at, min(value) AS low, arg_min(event_id, {'v': value, 'n': n}) AS low_at,
        CASE WHEN avg(value) FILTER (WHERE n > c // 2) > avg(value) FILTER (WHERE n <= (c + 1) // 2) THEN 'rising' WHEN avg(value) FILTER (WHERE n > c // 2) < avg(value) FILTER (WHERE n <= (c + 1) // 2) THEN 'falling' ELSE 'steady' END AS trend FROM r GROUP BY event_type"""
)
def value_trends(spark: SparkSession, d: str) -> DataFrame:
    return longitudinal.trends(table(spark, d, "events"), ["event_type"], "event_id", "value").drop("mean")


@query(
    f"SELECT case_id, s AS symptom, count(*) AS entries, min(day) AS first_date, max(day) AS last_date FROM (SELECT case_id, lower(coalesce(description, '')) AS t, {_DAY} AS day FROM {EVENTS}), (SELECT unnest([{', '.join(f"'{s}'" for s in longitudinal.SYMPTOMS)}]) AS s) WHERE contains(t, s) GROUP BY case_id, s"
)
def symptom_frequency(spark: SparkSession, d: str) -> DataFrame:
    rows = event_rows(spark, d, "case_id", "date", "description").withColumn("day", dates.parsed(F.col("date")))
    return longitudinal.symptom_frequency(rows, ["case_id"], F.col("description"), "day")


@query("SELECT event_type AS model, count(*) AS calls, sum(user_id)::BIGINT AS tokens, round(avg(value), 6) AS mean_response_time FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-14 00:00:00' AND TIMESTAMP '2024-01-15 00:00:00' GROUP BY event_type")
def usage_summary(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "events").select("ts", F.col("event_type").alias("model"), F.col("user_id").alias("tokens"), F.col("value").alias("response_time"))
    return longitudinal.usage(calls, "ts", F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).withColumn("mean_response_time", F.round("mean_response_time", 6))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3599999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS in_window FROM events")
def rate_window(spark: SparkSession, d: str) -> DataFrame:
    return longitudinal.calls_in_window(table(spark, d, "events").select("event_id", "user_id", "ts"), ["user_id"], "ts", 3600).select("event_id", "in_window")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 10")
def latest_calls(spark: SparkSession, d: str) -> DataFrame:
    return longitudinal.latest(table(spark, d, "events").select("event_id", "user_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 10).select("event_id")


#: Words in an exhibit's title and the template they lead to; the first that holds counts.
TITLE_RULES = [("imaging", "imaging_report"), ("lab", "lab_result"), ("therapy", "therapy_eval"), ("emergency", "emergency_visit"), ("surg", "surgical_report"), ("psych", "psych_visit"), ("consultative", "consultative_exam"), ("source statement", "medical_source_statement"), ("payment", "skip"), ("earnings", "skip")]


@query(
    f"SELECT template, count(*) AS bookmarks FROM (SELECT CASE {' '.join(f"WHEN contains(upper(coalesce(title, '')), '{w.upper()}') THEN '{t}'" for w, t in TITLE_RULES)} ELSE 'office_visit' END AS template FROM {TOC}) GROUP BY template"
)
def rule_routing(spark: SparkSession, d: str) -> DataFrame:
    return longitudinal.routed(toc_rows(spark, d), TITLE_RULES, F.col("title"), "template", "office_visit").groupBy("template").agg(F.count("*").alias("bookmarks"))


@query("SELECT range AS attempt, least(power(2.0, range), 60.0)::DOUBLE AS seconds FROM range(7)")
def retry_delays(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(7).select(F.col("id").alias("attempt"), longitudinal.retry_delay(F.col("id")).alias("seconds"))


@query("SELECT o_orderkey::VARCHAR AS job_id, o_orderdate AS created_at, (SELECT count(*) FROM orders) AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey::VARCHAR LIMIT 50")
def job_list(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("job_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))
    return jobs.listed(rows, "F", 50).select("job_id", "created_at", "total")


# ---------------------------------------------------------------- windows and whole runs


def _events_at(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS events, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = stream_events.windowed(_events_at(spark, d), "ts", ["event_type"], "1 hour")
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "events", F.round("total", 6).alias("total"))


@query("SELECT s AS start, event_type, count(*) AS events FROM (SELECT event_type, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY ALL")
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = stream_events.windowed(_events_at(spark, d), "ts", ["event_type"], "2 hours", "1 hour")
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "events")


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM events),
    s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS events FROM s GROUP BY user_id, k"""
)
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = stream_events.sessions(_events_at(spark, d), "ts", ["user_id"], "30 minutes")
    return rows.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "events")


def event_pages(events: DataFrame) -> DataFrame:
    """(case_id, page, text): all distinct source texts of each page in the order of their letters, each behind its event's date, provider and place."""
    named = lambda label, c: F.coalesce(F.concat(F.lit(f" | {label}: "), F.nullif(F.translate(c, "|\n", "  "), F.lit(""))), F.lit(""))
    said = F.coalesce(F.concat(F.lit("Seen on "), F.nullif(dates.written(dates.parsed(F.col("date"))), F.lit("")), named("provider", "provider"), named("facility", "location"), F.lit(" | ")), F.lit(""))
    texts = events.where("source_page IS NOT NULL AND source_text IS NOT NULL").select("case_id", F.col("source_page").alias("page"), F.concat(said, "source_text").alias("text"))
    return texts.groupBy("case_id", "page").agg(F.array_join(F.array_sort(F.collect_set("text")), "\n\n").alias("text"))


@query()
def chronology_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """The whole run over the bookmarks, with the source texts of a page's events as its text."""
    pages = event_pages(event_rows(spark, d, "case_id", "source_page", "source_text", "date", "provider", "location"))
    counts = table(spark, d, "claimants").groupBy("case_id").agg(F.max("total_document_pages").alias("total_pages"))
    return plan.run(toc_rows(spark, d).where("page_start IS NOT NULL"), counts, pages, RuleProvider(), plan.Options(calls_per_minute=None))


@query(
    f"""SELECT event_id, CASE WHEN coalesce(description, '') = '' THEN '**[Review Required]** Content could not be extracted.' ELSE '**General CE**<br>**History:** ' || CASE WHEN length(description) > 300 THEN left(description, 300) || '...' ELSE description END
        || '<br>**Physical Exam:** Gait: steady; ROM: full' END AS shown FROM {EVENTS}"""
)
def consultative_render(spark: SparkSession, d: str) -> DataFrame:
    rows = event_rows(spark, d, "description")
    findings = F.when(F.coalesce("description", F.lit("")) != "", F.lit('{"range_of_motion": "full", "gait_ambulation": "steady", "other": "x"}'))
    occurrence = F.create_map(F.lit("visit_type"), F.lit("consultative_exam"), F.lit("history_of_complaint"), F.col("description"), F.lit("physical_findings"), findings)
    return rows.select("event_id", occurrences.occurrence_text(F.lit("consultative_exam"), occurrence).alias("shown"))
