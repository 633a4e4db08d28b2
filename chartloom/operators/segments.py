"""Bookmarks into sections, exhibits and page ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.operators.prefix import SLICE, numbered, running, sliced

# Titles of exhibits, and of sections in the order in which they are tried.
EXHIBIT_TITLES = (r"\d+[A-F]\s*[-:]", r"Exhibit\s+[A-Z0-9]+", r"Ex\.\s*[A-Z0-9]+", r"Attachment\s+[A-Z0-9]+", r"Appendix\s+[A-Z0-9]+", r"Tab\s+[A-Z0-9]+")
SECTION_TITLES = {
    "A": r"^[A-Z]?\.\s*Payment|Section\s*A|^\s*A\.",
    "B": r"^[A-Z]?\.\s*Jurisdictional|Section\s*B|^\s*B\.",
    "D": r"^[A-Z]?\.\s*Earnings|Section\s*D|^\s*D\.",
    "E": r"^[A-Z]?\.\s*Disability|Section\s*E|^\s*E\.",
    "F": r"^[A-Z]?\.\s*Medical|Section\s*F|^\s*F\.",
}


def is_exhibit(title: Column, patterns: tuple[str, ...] = EXHIBIT_TITLES) -> Column:
    return F.coalesce(title.rlike("(?i)" + "|".join(patterns)), F.lit(False))


def section_of(title: Column) -> Column:
    """The first section whose pattern a title holds; null without one."""
    found = F.lit(None).cast("string")
    for section, pattern in reversed(SECTION_TITLES.items()):
        found = F.when(title.rlike(f"(?i){pattern}"), section).otherwise(found)
    return found


def exhibit_id(title: Column) -> Column:
    """Number and section letter at the start of a title, else its first ten characters."""
    return F.coalesce(F.nullif(F.regexp_extract(title, r"^(\d+[A-F])", 1), F.lit("")), F.left(title, F.lit(10)))


def is_medical(title: Column) -> Column:
    return F.coalesce(title.rlike(r"^\d+F"), F.lit(False))


def section_id(exhibit: Column, letters_only: bool = True) -> Column:
    """Last character of an exhibit's id in upper case; blank for other than letters if so asked."""
    last = F.upper(F.right(F.coalesce(exhibit, F.lit("")), F.lit(1)))
    return F.when(last.rlike("^[A-Z]$"), last).otherwise("") if letters_only else last


def end_pages(toc: DataFrame, page_count: int | None = None) -> DataFrame:
    """Adds page_end: the page before the next bookmark of the same or a higher level, else the last page.

    ``toc`` has case_id, ord, level, page_start and, without ``page_count``, total_pages. Read backwards, the
    next bookmark of each level that occurs is a running minimum, so a case of any size and depth is read once.
    """
    levels = sorted(r[0] for r in toc.select("level").where("level IS NOT NULL").distinct().collect())  # no more than bookmarks nest deep
    if not levels:
        return toc.withColumn("page_end", F.col("page_start"))  # an empty table, or one that says no level
    marked = toc.withColumn("_back", -F.col("ord").cast("long")).withColumns({f"_at{k}": F.when(F.col("level") <= level, F.struct("ord", "page_start")) for k, level in enumerate(levels)})
    rows = running(sliced(marked, ["case_id"], ["_back"]), ["case_id"], ["_back"], {f"_to{k}": ("min", f"_at{k}") for k in range(len(levels))}, inclusive=False)
    following = F.lit(None).cast("int")
    for k, level in enumerate(levels):
        following = F.when(F.col("level") == level, F.col(f"_to{k}.page_start")).otherwise(following)
    last = F.lit(page_count) if page_count is not None else F.col("total_pages")
    return rows.withColumn("page_end", F.greatest(F.coalesce(following - 1, last), F.col("page_start"))).drop(SLICE, "_back", *(f"_{x}{k}" for x in ("at", "to") for k in range(len(levels))))


def f_exhibits(toc: DataFrame, page_count: Column, most_pages: int | None = 50) -> DataFrame:
    """Medical exhibits of a case: exhibit_id, start and end page, pages kept and the last page read.

    An exhibit ends before the next medical exhibit in the order of bookmarks, the last at the file's
    end. Court files put a C before the number; it is dropped. Without ``most_pages`` all pages are kept.
    """
    title = F.regexp_extract("title", r"^C?(\d+F)\s*[-:]", 1)
    order = Window.partitionBy("case_id").orderBy("ord")
    found = toc.withColumn("exhibit_id", title).where("exhibit_id <> ''")
    ended = found.withColumn("end_page", F.coalesce(F.lead("page_start").over(order) - 1, page_count))
    pages = F.greatest(F.col("end_page") - F.col("page_start") + 1, F.lit(0))
    kept = pages if most_pages is None else F.least(pages, F.lit(most_pages))
    return ended.select("case_id", "ord", "exhibit_id", "page_start", "end_page", kept.alias("pages_read"), (F.col("page_start") + kept - 1).alias("last_read"))


def structure(toc: DataFrame) -> DataFrame:
    """Bookmarks, depth and top-level bookmarks of each case."""
    return toc.groupBy("case_id").agg(F.count("*").alias("bookmarks"), F.max("level").alias("max_depth"), F.count_if(F.col("level") == 1).alias("roots"))


def file_format(toc: DataFrame) -> DataFrame:
    """(case_id, format) by bookmarks: court_transcript, processed, else raw_ssa.

    Only the first bookmarks of a case decide, so ranks are taken after cutting each level short.
    """
    by = Window.partitionBy("case_id").orderBy("ord")
    by_level = Window.partitionBy("case_id", "level").orderBy("ord")
    low = F.lower(F.coalesce("title", F.lit("")))
    ranked = toc.select("case_id", "level", low.alias("t"), F.row_number().over(by).alias("n"), F.row_number().over(by_level).alias("k"))
    head = F.col("n") <= 5
    flags = ranked.groupBy("case_id").agg(
        F.bool_or(head & F.col("t").contains("certification")).alias("certified"),
        F.bool_or(head & F.col("t").contains("court") & F.col("t").contains("index")).alias("indexed"),
        F.count_if((F.col("level") == 2) & F.col("t").rlike(r"^c\d+[a-f]\s*-")).alias("c_exhibits"),
        F.bool_or((F.col("n") == 1) & (F.col("t") == "table of contents")).alias("contents"),
        F.count_if((F.col("level") == 3) & (F.col("k") <= 20) & F.col("t").rlike(r"^\(page\s+\d+\s+of\s+\d+\)")).alias("pages"),
    )
    kind = F.when(F.col("certified") | F.col("indexed") | (F.col("c_exhibits") >= 3), "court_transcript").when(F.col("contents") | (F.col("pages") >= 3), "processed").otherwise("raw_ssa")
    return flags.select("case_id", kind.alias("format"))


def latest_dde(exhibits: DataFrame) -> DataFrame:
    """The determination exhibit of each case that starts last; of equals the first bookmark's."""
    return exhibits.where(is_dde(F.col("title"))).groupBy("case_id").agg(F.max_by(F.struct("exhibit_id", "title", "page_start"), F.struct("page_start", -F.col("ord"))).alias("dde")).select("case_id", "dde.*")


# What the titles of determination exhibits hold.
DDE_TITLES = (
    "DDE", "DISABILITY DETERMINATION", "RFC ASSESSMENT", "RESIDUAL FUNCTIONAL CAPACITY", "PRTF", "PSYCHIATRIC REVIEW TECHNIQUE",
    "STATE AGENCY", "MEDICAL CONSULTANT", "PSYCHOLOGICAL CONSULTANT", "CASE ANALYSIS", "RATIONALE", "4734",
)
# Words of a medical exhibit's text.
MEDICAL_WORDS = ("medical", "doctor", "hospital", "treatment", "diagnosis", "patient")


def is_medical_exhibit(text: Column, exhibit: Column) -> Column:
    """Whether an exhibit is one of section F by its id, or its text speaks of treatment."""
    up, low = F.upper(F.coalesce(exhibit, F.lit(""))), F.lower(F.coalesce(text, F.lit("")))
    return up.contains("F:") | up.contains("F@") | up.endswith("F") | low.rlike("|".join(MEDICAL_WORDS))


def is_dde(title: Column) -> Column:
    up = F.upper(F.coalesce(title, F.lit("")))
    found = F.lit(False)
    for t in DDE_TITLES:
        found = found | up.contains(t)
    return found


def needs_vision(rows: DataFrame, key: str, scanned: str, order: str, sample: int = 20) -> DataFrame:
    """(key, scanned_pages, sampled_pages, scanned_ratio, recommendation) by the first pages of each file."""
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_n") <= sample)
    ratio = F.col("scanned_pages") / F.col("sampled_pages")
    return (
        first.groupBy(key).agg(F.count_if(scanned).alias("scanned_pages"), F.count("*").alias("sampled_pages"))
        .withColumn("scanned_ratio", ratio)
        .withColumn("recommendation", F.when(ratio > 0.5, "vision").when(ratio > 0.1, "hybrid").otherwise("text"))
    )


def is_scanned(text: Column, has_large_image: Column, raw_most: int = 150, clean_least: int = 100) -> Column:
    """A page of a large image and little text, raw or once court stamps are off."""
    from chartloom.functions.text import stripped, without_court_stamps

    raw = F.length(stripped(F.coalesce(text, F.lit(""))))
    clean = F.length(without_court_stamps(F.coalesce(text, F.lit(""))))
    return has_large_image & ((raw <= raw_most) | (clean < clean_least))


def batches(rows: DataFrame, keys: list[str], order: str, size: int = 10) -> DataFrame:
    """Consecutive rows in batches: keys, batch, first and last of ``order``, and how many."""
    n = F.col("_n") - 1
    rows = numbered(rows, keys, [order])
    return rows.withColumn("batch", F.floor(n / size)).groupBy(*keys, "batch").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("rows_in_batch"))
