"""Extracted entries: validation, sparseness, merging and recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.operators.prefix import numbered

# Accepted kinds of visits, the fallback, and what fills missing members.
VISIT_TYPES = (
    "office_visit", "imaging_report", "therapy_eval", "lab_result", "surgical_report", "emergency_visit", "medical_source_statement",
    "diagnostic_study", "inpatient_admission", "procedural_visit", "psych_visit", "consultative_exam",
)
DEFAULT_VISIT, DEFAULT_NAME = "office_visit", "Not Specified"

# Words that tell a kind of visit.
VISIT_WORDS = {
    "imaging_report": ("radiology", "radiologist", "x-ray", "ct scan", "mri", "ultrasound", "impression:", "findings:", "technique:"),
    "lab_result": ("laboratory", "lab result", "cbc", "cmp", "bmp", "lipid panel", "reference range", "abnormal", "urinalysis", "hgb", "wbc"),
    "surgical_report": ("operative report", "operative note", "pre-op", "post-op", "preoperative diagnosis", "postoperative diagnosis", "surgeon:", "anesthesia", "procedure performed"),
    "emergency_visit": ("emergency department", "emergency room", "ed visit", "er visit", "triage", "chief complaint", "disposition:", "esi level"),
    "therapy_eval": ("physical therapy", "occupational therapy", "speech therapy", "pt eval", "ot eval", "rom:", "range of motion", "strength:"),
    "consultative_exam": ("consultative examination", "ce report", "disability determination", "dds", "functional capacity", "referred by ssa"),
    "psych_visit": ("psychiatr", "psycholog", "mental status exam", "mse:", "mood:", "affect:", "thought process", "lcsw", "lpc"),
    "inpatient_admission": ("admission date", "discharge date", "hospital course", "discharge summary", "admitted to", "length of stay"),
    "diagnostic_study": ("emg", "nerve conduction", "ekg", "ecg", "eeg", "sleep study", "pulmonary function", "stress test"),
    "medical_source_statement": ("medical source statement", "rfc", "functional capacity", "work limitations", "sedentary", "light work", "medium work"),
}

# Members that count as content whatever the kind of visit.
FALLBACK_FIELDS = ("chief_complaint", "findings", "assessment", "assessment_diagnoses", "plan_of_care")


def visit_types_of(text: Column) -> Column:
    """Sorted array of all kinds of visits that a text may tell of; always with the fallback."""

    def told(low: Column) -> Column:
        kinds = []
        for kind, said in VISIT_WORDS.items():
            holds = F.lit(False)
            for word in said:
                holds = holds | low.contains(word)
            kinds.append(F.when(holds, kind))
        return F.array_sort(F.array_compact(F.array(*kinds, F.lit(DEFAULT_VISIT))))

    # Bound by a lambda, the text is put into lower case once and not once a word.
    return F.element_at(F.transform(F.array(F.lower(F.coalesce(text, F.lit("")))), told), 1)


def inferred_visit_type(occurrence: Column) -> Column:
    """Kind of visit by which members of a map of JSON texts hold something."""
    holds = lambda k: truthy(F.element_at(occurrence, k))
    return (
        F.when(holds("test_name") | holds("test"), "lab_result")
        .when(holds("imaging_type") | holds("procedure_type"), "imaging_report")
        .when(holds("therapy_type"), "therapy_eval")
        .when(holds("opinion_type") | holds("functional_limitations"), "medical_source_statement")
        .otherwise(DEFAULT_VISIT)
    )


def truthy(json_text: Column) -> Column:
    """Whether a member counts as set: not null, empty, 0, false, [] or {}."""
    return F.coalesce(~F.regexp_replace(json_text, r"\s", "").isin("", "0", "0.0", "false", "null", "[]", "{}"), F.lit(False))


def validated(entries: DataFrame, exhibit: str) -> DataFrame:
    """Entries (a map of JSON texts ``entry``) with a date; members that are missing, not null, get defaults."""
    has = lambda k: F.map_contains_key("entry", k)
    member = lambda k, default: F.when(has(k), F.element_at("entry", k)).otherwise(default)
    kind = F.element_at("entry", "visit_type")
    return entries.where(truthy(F.element_at("entry", "date"))).withColumns(
        {
            "date": F.element_at("entry", "date"),
            "provider": member("provider", F.lit(DEFAULT_NAME)),
            "facility": member("facility", F.lit(DEFAULT_NAME)),
            "exhibit_reference": member("exhibit_reference", F.col(exhibit)),
            "visit_type": F.when(kind.isin(*VISIT_TYPES), kind).otherwise(DEFAULT_VISIT),
            "occurrence": member("occurrence_treatment", F.lit("{}")),
        }
    )


def is_sparse(visit_type: Column, occurrence: Column, fields: Column | None = None, said: Column | None = None) -> Column:
    """Whether an entry says next to nothing: no member of ``fields`` (or the fallback ones) is a text of
    more than ten characters, a filled list or an object with a filled member. ``occurrence`` is a map of JSON texts.
    Where it is null, ``said`` may hold an occurrence that is plain text: it is sparse below twenty characters."""
    wanted = F.array(*map(F.lit, FALLBACK_FIELDS)) if fields is None else F.array_union(fields, F.array(*map(F.lit, FALLBACK_FIELDS)))
    value = lambda kv: F.trim(kv["value"])
    says = lambda kv: F.array_contains(wanted, kv["key"]) & F.coalesce(
        F.when(value(kv).startswith("["), ~F.regexp_replace(value(kv), r"\s", "").isin("[]"))
        .when(value(kv).startswith("{"), value(kv).rlike(r':\s*(?!""|null|false|0\b|\[\s*\]|\{\s*\})\S'))
        .otherwise(F.length(value(kv)) > 10),
        F.lit(False),
    )
    by_members = occurrence.isNull() | ~F.exists(F.map_entries(occurrence), says)
    if said is not None:
        short = F.length(F.regexp_replace(said, r"^\s+|\s+$", "")) < 20
        by_members = F.when(occurrence.isNull() & said.isNotNull(), short).otherwise(by_members)
    return (F.coalesce(visit_type, F.lit("")) == "") | by_members


def is_empty(occurrence: Column) -> Column:
    """The weaker test: no member but visit_type and applies_to is a text, list or object with anything in it."""
    says = lambda kv: ~kv["key"].isin("visit_type", "applies_to") & truthy(kv["value"]) & ~F.trim(kv["value"]).rlike(r"^(?:-?\d+(?:\.\d+)?|true)$") & (F.trim(kv["value"]) != "")
    return occurrence.isNull() | ~F.exists(F.map_entries(occurrence), says)


def signature(date: Column, visit_type: Column, provider: Column) -> Column:
    """date|visit type|first twenty letters of the provider in lower case without spaces."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(text(date), F.lit("|"), text(visit_type), F.lit("|"), F.left(F.replace(F.lower(text(provider)), F.lit(" "), F.lit("")), F.lit(20)))


def _first_of(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def merged_chunks(entries: DataFrame, scope: list[str]) -> DataFrame:
    """Entries of a text's chunks (chunk_index, seq, total_chunks), the first of each signature; those of
    later chunks tell theirs in from_chunk. A text of one chunk keeps all."""
    signed = entries.withColumn("_sig", F.when(F.col("total_chunks") > 1, signature(F.col("date"), F.col("visit_type"), F.col("provider"))).otherwise(F.concat(F.lit("#"), F.col("seq").cast("string"))))
    kept = _first_of(signed, [*scope, "_sig"], ["chunk_index", "seq"])
    return kept.withColumn("from_chunk", F.when(F.col("chunk_index") > 0, F.col("chunk_index"))).drop("_sig")


def richest(entries: DataFrame, keys: list[str]) -> DataFrame:
    """One entry a key: the first that isn't ``sparse``, else the first; in the order in which keys were first seen (first_seq)."""
    by = Window.partitionBy(*keys)
    seen = entries.withColumns({"first_seq": F.min("seq").over(by), "_n": F.row_number().over(by.orderBy("sparse", "seq"))})
    return seen.where("_n = 1").drop("_n")


def recovered(entries: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Sparse entries filled from a second reading, and what only that found.

    The first second-reading entry of a key counts. It replaces the occurrence of a sparse entry unless it
    is sparse itself; the others are kept. Keys that only the second reading has are appended, unless
    sparse. Both need seq, sparse and occurrence; enriched tells what was filled or added.
    """
    first = _first_of(second, keys, ["seq"])
    other = first.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("occurrence").alias("_occurrence"), F.col("sparse").alias("_sparse"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    fill = F.col("sparse") & ~F.coalesce(F.col("_sparse"), F.lit(True))
    filled = entries.join(other, same, "left").withColumns({"occurrence": F.when(fill, F.col("_occurrence")).otherwise(F.col("occurrence")), "enriched": fill}).select(*entries.columns, "enriched")
    held = entries.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).distinct()
    fresh = _first_of(second.where("NOT sparse"), keys, ["seq"]).join(held, same, "left_anti").withColumn("enriched", F.lit(True))
    return filled.unionByName(fresh.select(*entries.columns, "enriched"))


def consumed(sparse: DataFrame, retried: DataFrame, keys: list[str]) -> DataFrame:
    """Retried rows take sparse rows of the same key one for one, in order; (keys, sparse_seq, retry_seq, outcome):
    filled, appended (no sparse row was left) or leftover."""
    left = numbered(sparse.select(*keys, "seq"), keys, ["seq"]).withColumnRenamed("seq", "sparse_seq")
    right = numbered(retried.select(*keys, "seq"), keys, ["seq"]).withColumnRenamed("seq", "retry_seq")
    both = left.join(right, [*keys, "_n"], "full")
    return both.select(*keys, "sparse_seq", "retry_seq", F.when(F.col("sparse_seq").isNull(), "appended").when(F.col("retry_seq").isNull(), "leftover").otherwise("filled").alias("outcome"))


def status(results: DataFrame) -> DataFrame:
    """Total, succeeded and failed exhibits of each case by whether ``error`` is set."""
    return results.groupBy("case_id").agg(F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"))
