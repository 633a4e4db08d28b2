"""From bookmarks and pages to a dated, cited chronology."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.functions import citations as cite
from chartloom.functions import dates
from chartloom.operators import chronology, chunks, citations, entries, repair, routing, segments
from chartloom.operators.prefix import numbered
from chartloom.session import cut
from chartloom.sources.providers import Provider, VisionProvider, extract, extract_images

KEYS = ["case_id", "exhibit_id"]


@dataclass(frozen=True)
class Options:
    chunk_chars: int = 40_000
    overlap_chars: int = 500
    least_chars: int = 1_000
    match_threshold: float = 3.0
    #: Pages of each exhibit that are read, from its first; all by default.
    pages_per_exhibit: int | None = None
    calls_per_minute: int | None = 50
    images_per_call: int = 10


def exhibits(toc: DataFrame, page_counts: DataFrame, options: Options = Options()) -> DataFrame:
    """Medical exhibits of every case with their pages' bounds."""
    return segments.f_exhibits(toc.join(page_counts, "case_id", "left"), F.col("total_pages"), options.pages_per_exhibit)


def page_rows(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Pages (case_id, page, text) of exhibits, with what their headers say; blank pages are left out."""
    index = citations.page_index(found.select("case_id", "exhibit_id", F.col("page_start").alias("start_page"), F.col("last_read").alias("end_page"), "ord"), ["case_id"], pages, "page")
    placed = pages.join(index, ["case_id", "page"]).where(F.trim("text") != "")
    header = citations.header(F.col("text"), F.col("page"), F.col("exhibit_id"), F.col("page") - F.col("relative_page") + 1, F.lit(None).cast("int"))
    return placed.withColumn("header", header).select("case_id", "exhibit_id", F.col("page").alias("absolute_page"), "relative_page", "text", F.when(F.col("header.detection_method") == "regex", F.col("header.confidence")).otherwise(0.0).alias("confidence"))


def extracted(pages: DataFrame, provider: Provider, options: Options = Options()) -> DataFrame:
    """Validated entries of all exhibits: combined, chunked, read by the provider, repaired, merged.

    The provider's answers are written to the shared folder before use, as a call must not be made twice.
    """
    whole = citations.combined_text(pages, KEYS).withColumn("_key", F.to_json(F.struct(*KEYS)))
    parts = chunks.chunked(whole, "_key", "combined_text", options.chunk_chars, options.overlap_chars, options.least_chars, tail=False)
    answers = cut(extract(parts, provider, key="_key", per_worker=options.calls_per_minute).join(parts.select(F.col("_key").alias("exhibit_id"), "chunk_index", "total_chunks"), ["exhibit_id", "chunk_index"]))
    keyed = answers.where("error IS NULL").withColumn("_answer", F.to_json(F.struct("exhibit_id", "chunk_index", "total_chunks")))
    read = repair.entries(keyed, "_answer", "response")
    place = F.from_json("_answer", "exhibit_id STRING, chunk_index INT, total_chunks INT")
    rows = read.withColumn("_p", place).select(F.from_json("_p.exhibit_id", "case_id STRING, exhibit_id STRING").alias("_k"), "_p.chunk_index", "_p.total_chunks", "seq", F.from_json("entry", "map<string,string>").alias("entry"))
    checked = entries.validated(rows.select("_k.*", "chunk_index", "total_chunks", "seq", "entry"), "exhibit_id")
    return entries.merged_chunks(checked.withColumn("seq", F.col("chunk_index") * 1_000_000 + F.col("seq")), KEYS)


def cited(found: DataFrame, pages: DataFrame, options: Options = Options()) -> DataFrame:
    """Entries with the page that they come from."""
    numbered = cut(found.withColumn("entry_id", F.concat_ws("/", *KEYS, F.col("seq").cast("string"))))
    terms = citations.search_terms(F.col("date"), F.col("provider"), F.col("facility"))
    matched = citations.match_pages(numbered.select("entry_id", *KEYS, terms.alias("terms")), pages, KEYS, options.match_threshold)
    at = pages.select(*KEYS, "absolute_page", "relative_page")
    ends = at.select(*KEYS, F.col("absolute_page").alias("end_absolute_page"), F.col("relative_page").alias("end_relative_page"))
    placed = matched.join(at, [*KEYS, "absolute_page"], "left").join(ends, [*KEYS, "end_absolute_page"], "left")
    text = cite.citation(F.col("absolute_page"), F.col("exhibit_id"), F.col("relative_page"), F.col("end_absolute_page"), F.col("end_relative_page"), F.col("is_estimated"))
    return numbered.join(placed.select("entry_id", "absolute_page", "match_score", "confidence", "match_method", text.alias("source")), "entry_id", "left")


def image_batches(images: DataFrame, found: DataFrame, options: Options = Options()) -> DataFrame:
    """Scanned pages (case_id, page, image) of exhibits in batches: exhibit_id (a key of case and exhibit), batch, pages, images and the exhibit's start."""
    index = citations.page_index(found.select("case_id", "exhibit_id", F.col("page_start").alias("start_page"), F.col("last_read").alias("end_page"), "ord"), ["case_id"], images, "page")
    placed = images.where("image IS NOT NULL").select("case_id", "page", "image").join(index, ["case_id", "page"])
    at = numbered(placed.select("case_id", "exhibit_id", "page"), KEYS, ["page"]).withColumn("batch", F.floor((F.col("_n") - 1) / options.images_per_call)).drop("_n")
    # Only places are numbered; the images join their batch afterwards, a bounded number each.
    batched = placed.join(at, ["case_id", "exhibit_id", "page"]).groupBy(*KEYS, "batch").agg(F.array_sort(F.collect_list(F.struct("page", "image", "relative_page"))).alias("p"))
    return batched.select(F.to_json(F.struct(*KEYS)).alias("exhibit_id"), "batch", F.col("p.page").alias("pages"), F.col("p.image").alias("images"), (F.col("p.page")[0] - F.col("p.relative_page")[0] + 1).alias("start"))


def seen(batches: DataFrame, provider: VisionProvider, options: Options = Options()) -> DataFrame:
    """Validated entries read from images, each citing the pages of its batch; failed batches give none."""
    held = cut(batches)
    answers = cut(extract_images(held, provider, per_worker=options.calls_per_minute))
    placed = answers.where("error IS NULL").join(held.select("exhibit_id", F.col("batch").cast("int").alias("chunk_index"), "pages", "start"), ["exhibit_id", "chunk_index"])
    read = repair.entries(placed.withColumn("_answer", F.to_json(F.struct("exhibit_id", "chunk_index", "pages", "start"))), "_answer", "response")
    of = F.from_json("_answer", "exhibit_id STRING, chunk_index INT, pages ARRAY<INT>, start INT")
    rows = read.withColumn("_p", of).select(F.from_json("_p.exhibit_id", "case_id STRING, exhibit_id STRING").alias("_k"), "_p.*", "seq", F.from_json("entry", "map<string,string>").alias("entry")).select("_k.case_id", "_k.exhibit_id", "chunk_index", "pages", "start", "seq", "entry")
    checked = entries.validated(rows, "exhibit_id")
    first, last = F.col("pages")[0], F.element_at("pages", -1)
    relative = lambda p: (p - F.col("start") + 1).cast("int")
    text = cite.citation(first, F.col("exhibit_id"), relative(first), F.when(last > first, last), F.when(last > first, relative(last)), F.lit(False))
    return checked.withColumns({"seq": F.col("chunk_index") * 1_000_000 + F.col("seq"), "absolute_page": first, "match_score": F.lit(0.0), "confidence": F.lit(0.95), "match_method": F.lit("vision"), "source": text})


def chronology_of(found: DataFrame) -> DataFrame:
    """Dated rows with rendered occurrences: lab panels grouped, duplicates dropped."""
    occurrence = F.coalesce(F.from_json("occurrence", "map<string,string>"), F.create_map(F.lit("findings"), F.col("occurrence")))
    rows = found.withColumns({"date": dates.parsed(F.col("date")), "occurrence": chronology.rendered(occurrence)}).where("date IS NOT NULL")
    return chronology.processed(rows.select("case_id", "seq", "date", "provider", "facility", "occurrence", "source"), ["case_id"])


def run(toc: DataFrame, page_counts: DataFrame, pages: DataFrame, provider: Provider, options: Options = Options(), images: DataFrame | None = None, vision: VisionProvider | None = None, formats: DataFrame | None = None) -> DataFrame:
    """The chronology of every case, all cases at once.

    Pages with text are read by ``provider``, scanned pages (case_id, page, image) by ``vision``. Where the
    cases' ``formats`` are given, court files are read by their images alone and processed files by their
    text alone.
    """
    found = exhibits(toc, page_counts, options)
    if formats is not None:
        pages = routing.allowed(pages, formats, "text")
        images = routing.allowed(images, formats, "vision") if images is not None else None
    rows = cut(page_rows(pages, found))
    all_ = cited(extracted(rows, provider, options), rows, options)
    if images is not None and vision is not None:
        columns = ["case_id", "seq", "date", "provider", "facility", "occurrence", "source"]
        # Entries of images follow those of text.
        more = seen(image_batches(images, found, options), vision, options).withColumn("seq", F.col("seq") + F.lit(1 << 40))
        all_ = all_.select(*columns).unionByName(more.select(*columns))
    return chronology_of(all_)
