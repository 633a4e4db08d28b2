"""Determinations of cases, read from their exhibits by a provider."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.operators import repair, segments
from chartloom.session import cut
from chartloom.sources.providers import Provider, VisionProvider, extract, extract_images

PROMPT = "Extract the fields of this disability determination as one JSON object:\n{medical_content}"
VISION_PROMPT = "Extract the fields of the disability determination on these {page_count} page images, pages {page_nums}, as one JSON object."


def latest(toc: DataFrame) -> DataFrame:
    """(case_id, exhibit_id, title, page_start, page_end): the determination of section A that starts last, of each case."""
    exhibits = toc.withColumn("exhibit_id", F.regexp_extract("title", r"^(\d+A)\b", 1)).where("exhibit_id <> ''")
    kept = segments.latest_dde(exhibits)
    ends = exhibits.groupBy("case_id", "exhibit_id", "page_start").agg(F.max("page_end").alias("page_end"))
    return kept.join(ends, ["case_id", "exhibit_id", "page_start"])


def contents(found: DataFrame, pages: DataFrame) -> DataFrame:
    """(case_id, mode, text, numbers, images): a case whose determination has scanned pages is read by those alone, else by its text.

    ``pages`` has case_id, page, text and image. Pages of a determination are few, so they are gathered.
    """
    own = pages.join(found.select("case_id", "page_start", "page_end"), "case_id").where(F.col("page").between(F.col("page_start"), F.col("page_end")))
    said = F.when(F.coalesce(F.col("text"), F.lit("")) != "", F.struct("page", "text"))
    seen = F.when(F.col("image").isNotNull(), F.struct("page", "image"))
    both = own.groupBy("case_id").agg(F.array_sort(F.collect_list(said)).alias("t"), F.array_sort(F.collect_list(seen)).alias("i"))
    scanned = F.size("i") > 0
    return both.select("case_id", F.when(scanned, "vision").otherwise("text").alias("mode"), F.when(~scanned, F.array_join(F.transform("t", lambda x: x["text"]), "\n")).alias("text"), F.col("i.page").alias("numbers"), F.col("i.image").alias("images"))


def parsed(toc: DataFrame, pages: DataFrame, provider: Provider, vision: VisionProvider, calls_per_minute: int | None = 50) -> DataFrame:
    """(case_id, extraction_mode, fields, confidence, error) of each case's latest determination.

    A determination without text or image has the error "No text extracted"; a failed call has its error, no
    fields and confidence 0. Answers that were cut off are mended.
    """
    given = cut(contents(latest(toc), pages))
    blank = given.where("mode = 'text' AND trim(text) = ''").select("case_id", "mode", F.lit(None).cast("string").alias("response"), F.lit("No text extracted").alias("error"))
    before, after = PROMPT.split("{medical_content}")
    asked = given.where("mode = 'text' AND trim(text) <> ''").select("case_id", F.lit(0).alias("chunk_index"), F.concat(F.lit(before), "text", F.lit(after)).alias("text"))
    told = extract(asked, provider, key="case_id", per_worker=calls_per_minute).withColumn("mode", F.lit("text"))
    shown = given.where("mode = 'vision'").select(F.col("case_id").alias("exhibit_id"), F.lit(0).alias("batch"), F.col("numbers").alias("pages"), "images")
    read = extract_images(shown, vision, VISION_PROMPT, per_worker=calls_per_minute).withColumn("mode", F.lit("vision"))
    answers = cut(told.unionByName(read).select(F.col("exhibit_id").alias("case_id"), "mode", "response", "error").unionByName(blank))
    fields = repair.determinations(answers.where("error IS NULL"), "case_id", "response")
    sure = repair.normalized(fields, "case_id", "response").select("case_id", "confidence")
    return (
        answers.select("case_id", F.col("mode").alias("extraction_mode"), "error").join(fields.withColumnRenamed("response", "fields"), "case_id", "left").join(sure, "case_id", "left")
        .select("case_id", "extraction_mode", F.coalesce("fields", F.lit("{}")).alias("fields"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "error")
    )
