"""Which page a passage comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.functions.text import normalized_for_match, stripped

# Terms that say nothing, and the weights of those that do.
SKIPPED = ("not specified", "unknown", "n/a", "none", "unspecified", "")
WEIGHTS = {"date": 3.0, "provider": 2.0, "facility": 2.0, "diagnosis": 1.0, "procedure": 1.0}

# Page headers, from the surest.
BAR = r"(?i)(\d+F)\s*[-–—]\s*(\d+)\s*of\s*(\d+)"
STAMP = r"(?is)EXHIBIT\s*NO\.?\s*(\d+F).*?PAGE:?\s*(\d+)\s*(?:OF\s*(\d+))?"
BATES = r"\b([A-Z]{2,5}\d{6,9})\b"
TRANSCRIPT = r"(?i)Page\s+(\d+)(?:\s+of\s+(\d+))?"

#: Pages of a range that are listed at a time.
LISTED = 100_000


def page_index(ranges: DataFrame, keys: list[str], asked: DataFrame | None = None, *pages: str) -> DataFrame:
    """(keys, page, exhibit_id, relative_page) of every page of inclusive ranges (exhibit_id, start_page, end_page, ord).

    Where ranges overlap the last in order holds. Ranges without id or start, or reversed, are left out.
    A lookup is then an equi-join, where a join on bounds would compare every page with every range. Where the
    rows to be looked up are given with their columns of pages, only pages from the least to the greatest that a key
    asks for are listed, so that a range whose end is a slip of the pen costs no more than others.
    """
    sound = ranges.where("exhibit_id <> '' AND start_page > 0 AND end_page >= start_page").select(*keys, "exhibit_id", "start_page", "ord", F.col("start_page").cast("long").alias("_a"), F.col("end_page").cast("long").alias("_b"))
    if asked is not None:
        least, most = (f(*pages) if len(pages) > 1 else F.col(pages[0]) for f in (F.least, F.greatest))
        bounds = asked.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.min(least).alias("_lo"), F.max(most).alias("_hi")).where("_lo IS NOT NULL")
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & (F.col(k) == F.col(f"_k{i}"))
        sound = sound.join(bounds, same).withColumns({"_a": F.greatest("_a", "_lo"), "_b": F.least("_b", "_hi")}).where("_a <= _b")
    begun = sound.select(*keys, "exhibit_id", "start_page", "ord", "_b", F.explode(F.sequence("_a", "_b", F.lit(LISTED).cast("long"))).alias("_a"))
    listed = begun.select(*keys, "exhibit_id", "start_page", "ord", F.explode(F.sequence("_a", F.least(F.col("_b"), F.col("_a") + LISTED - 1))).alias("_p")).withColumn("page", F.col("_p").cast("int"))
    return listed.groupBy(*keys, "page").agg(F.max(F.struct("ord", "exhibit_id", "start_page")).alias("r")).select(*keys, "page", "r.exhibit_id", (F.col("page") - F.col("r.start_page") + 1).alias("relative_page"))


def resolve(rows: DataFrame, index: DataFrame, keys: list[str], page: str, prefix: str = "") -> DataFrame:
    """Adds exhibit_id and relative_page of a page, null outside all exhibits."""
    at = index.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("page").alias("_page"), F.col("exhibit_id").alias(f"{prefix}exhibit_id"), F.col("relative_page").alias(f"{prefix}relative_page"))
    same = F.col(page) == F.col("_page")
    for i, k in enumerate(keys):
        same = same & (rows[k] == F.col(f"_k{i}"))
    return rows.join(at, same, "left").drop("_page", *(f"_k{i}" for i in range(len(keys))))


def search_terms(date: Column, provider: Column, facility: Column, diagnoses: Column | None = None, procedures: Column | None = None) -> Column:
    """Array of (value, weight, fuzzy): what of an entry to look for on pages."""
    keep = lambda c: ~F.lower(F.coalesce(c, F.lit(""))).isin(*SKIPPED)
    one = lambda c, w, fuzzy: F.when(keep(c), F.array(F.struct(c.alias("value"), F.lit(w).alias("weight"), F.lit(fuzzy).alias("fuzzy"))))
    none = F.array().cast("array<struct<value:string,weight:double,fuzzy:boolean>>")
    lists = [F.coalesce(one(c, w, f), none) for c, w, f in ((F.nullif(stripped(date), F.lit("")), WEIGHTS["date"], False), (provider, WEIGHTS["provider"], True), (facility, WEIGHTS["facility"], True))]
    for many, w in ((diagnoses, WEIGHTS["diagnosis"]), (procedures, WEIGHTS["procedure"])):
        if many is not None:
            said = F.filter(F.slice(F.coalesce(many, F.array().cast("array<string>")), 1, 2), lambda x: (F.length(x) > 3) & keep(x))
            lists.append(F.transform(said, lambda x: F.struct(x.alias("value"), F.lit(w).alias("weight"), F.lit(True).alias("fuzzy"))))  # noqa: B023
    return F.concat(*lists)


def match_pages(entries: DataFrame, pages: DataFrame, within: list[str], threshold: float = 3.0) -> DataFrame:
    """Best page of each entry: (entry_id, absolute_page, end_absolute_page, match_score, confidence, match_method, is_estimated).

    ``entries`` has entry_id, the columns ``within`` and terms (see search_terms); ``pages`` has those
    columns, absolute_page and text. An entry meets only the pages of its own exhibit (an equi-join);
    a page scores the weights of the terms it holds. The best page has the greatest score of at least
    ``threshold``, of equals the earliest; pages beside it join in from 0.7 of the threshold. An
    entry that matches none cites the first page of its exhibit as an estimate; without pages it is left out.
    """
    page_text = pages.select(*within, "absolute_page", F.lower("text").alias("_low"), normalized_for_match(F.col("text")).alias("_norm"))
    term = entries.select("entry_id", *within, F.explode("terms").alias("t")).select("entry_id", *within, "t.*")
    wanted = term.withColumn("_value", F.when(F.col("fuzzy"), normalized_for_match(F.col("value"))).otherwise(F.lower("value")))
    hit = F.when(F.col("fuzzy"), F.contains("_norm", "_value")).otherwise(F.contains("_low", "_value"))
    # A term that many entries of an exhibit share is looked for once on each page.
    asked = wanted.select(*within, "_value", "fuzzy").distinct()
    hits = asked.join(page_text, within).where(hit).select(*within, "_value", "fuzzy", "absolute_page")
    scores = wanted.join(hits, [*within, "_value", "fuzzy"]).groupBy("entry_id", "absolute_page").agg(F.sum("weight").alias("score"))
    by_page = Window.partitionBy("entry_id").orderBy("absolute_page")
    beside = scores.withColumns({"_before": F.max("score").over(by_page.rangeBetween(-1, -1)), "_after": F.max("score").over(by_page.rangeBetween(1, 1))})
    near = threshold * 0.7
    best = beside.where(F.col("score") >= threshold).groupBy("entry_id").agg(F.max_by(F.struct("absolute_page", "score", "_before", "_after"), F.struct("score", -F.col("absolute_page"))).alias("b"))
    start = F.when(F.col("b._before") >= near, F.col("b.absolute_page") - 1).otherwise(F.col("b.absolute_page"))
    end = F.when(F.col("b._after") >= near, F.col("b.absolute_page") + 1).otherwise(F.col("b.absolute_page"))
    first_score = F.when(F.col("b._before") >= near, F.col("b._before")).otherwise(F.col("b.score"))
    found = best.select("entry_id", start.alias("_start"), end.alias("_end"), F.col("b.score").alias("_score"), first_score.alias("_first"))
    first = pages.groupBy(*within).agg(F.min("absolute_page").alias("_page"))
    all_ = entries.select("entry_id", *within).join(first, within).join(found, "entry_id", "left")
    is_found = F.col("_score").isNotNull()
    return all_.select(
        "entry_id", *within,
        F.coalesce("_start", "_page").alias("absolute_page"),
        F.when(F.col("_end") > F.col("_start"), F.col("_end")).alias("end_absolute_page"),
        F.coalesce("_score", F.lit(0.0)).alias("match_score"),
        F.when(is_found, F.least(F.lit(1.0), F.col("_first") / 10)).otherwise(0.3).alias("confidence"),
        F.when(is_found, "search").otherwise("fallback").alias("match_method"),
        (~is_found).alias("is_estimated"),
    )


def header(text: Column, page: Column, exhibit: Column, start: Column, total: Column, least: float = 0.3) -> Column:
    """Struct of what a page's header says: source_type, exhibit_id, relative_page, total_pages, bates_number,
    confidence, detection_method, raw_match, is_estimated; the first of bar, stamp, Bates number,
    transcript, place in the exhibit that reaches ``least``, else a guess."""
    head = F.left(F.coalesce(text, F.lit("")), F.lit(500))
    whole = F.coalesce(text, F.lit(""))
    part = lambda c, p, i: F.nullif(F.regexp_extract(c, p, i), F.lit(""))
    number = lambda c: c.try_cast("int")
    none = F.lit(None)

    def made(kind: Column | str, ex: Column, rel: Column, tot: Column, bates: Column, sure: float, how: str, raw: Column, guess: bool) -> Column:
        return F.struct(
            (F.lit(kind) if isinstance(kind, str) else kind).alias("source_type"), ex.cast("string").alias("exhibit_id"), rel.cast("int").alias("relative_page"), tot.cast("int").alias("total_pages"),
            bates.cast("string").alias("bates_number"), F.lit(sure).alias("confidence"), F.lit(how).alias("detection_method"), raw.cast("string").alias("raw_match"), F.lit(guess).alias("is_estimated"),
        )

    tries = [
        (0.95, head.rlike(BAR), made("ere", F.upper(part(head, BAR, 1)), number(part(head, BAR, 2)), number(part(head, BAR, 3)), none, 0.95, "regex", part(head, BAR, 0), False)),
        (0.90, whole.rlike(STAMP), made("ere", F.upper(part(whole, STAMP, 1)), number(part(whole, STAMP, 2)), number(part(whole, STAMP, 3)), none, 0.90, "regex", part(whole, STAMP, 0), False)),
        (0.85, head.rlike(BATES), made("bates", none, none, none, part(head, BATES, 1), 0.85, "regex", part(head, BATES, 0), False)),
        (0.80, head.rlike(TRANSCRIPT), made("transcript", none, number(part(head, TRANSCRIPT, 1)), number(part(head, TRANSCRIPT, 2)), none, 0.80, "regex", part(head, TRANSCRIPT, 0), False)),
        (0.60, (F.coalesce(start, F.lit(0)) != 0) & (page >= start), made(F.when(F.coalesce(exhibit, F.lit("")) != "", "ere").otherwise("generic"), F.nullif(exhibit, F.lit("")), page - start + 1, total, none, 0.60, "position", none, True)),
    ]
    found = made("generic", exhibit, none, none, none, 0.25, "fallback", none, True)
    for sure, test, struct in reversed(tries):
        if sure >= least:
            found = F.when(test, struct).otherwise(found)
    return found


def combined_text(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Texts of a key's pages in order, a blank line between; pages without a sure header get a marker."""
    marked = F.when(F.coalesce(F.col("confidence"), F.lit(0.0)) > 0.5, F.col("text")).otherwise(F.concat(F.lit("[PAGE "), F.col("absolute_page").cast("string"), F.lit("]\n"), "text"))
    rows = pages.where("text IS NOT NULL").select(*keys, "absolute_page", marked.alias("_text"))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("absolute_page", "_text"))), lambda x: x["_text"]), "\n\n").alias("combined_text"), F.count("*").alias("pages"))


def with_fallback(entries: DataFrame, exhibits: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without a page cite their exhibit's first page, estimated; others keep theirs."""
    bounds = exhibits.select(*keys, F.col("page_start").alias("_first"), F.col("page_end").alias("_last"))
    joined = entries.join(bounds, keys, "left")
    own = F.col("absolute_page").isNotNull()
    return joined.withColumns({"absolute_page": F.coalesce("absolute_page", "_first"), "end_absolute_page": F.when(own, F.lit(None)).otherwise(F.col("_last")), "is_estimated": ~own & F.col("_first").isNotNull()}).drop("_first", "_last")
