"""Page citations as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A citation of one page or of pages up to an end.
CITATION = (
    "STRUCT<absolute_page: INT, exhibit_id: STRING, relative_page: INT, total_pages: INT, end_relative_page: INT, end_absolute_page: INT, "
    "bates_number: STRING, transcript_line: INT, source_type: STRING, is_estimated: BOOLEAN, confidence: DOUBLE>"
)


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def citation(absolute: Column, exhibit: Column, relative: Column, end_absolute: Column, end_relative: Column, estimated: Column, bates: Column | None = None, style: str = "full") -> Column:
    """Bates number, else exhibit and page in the style full, exhibit or absolute, else the page alone."""
    at = _text(F.when(estimated, "~").otherwise(""), relative)
    single = _text(exhibit, "@", at, " (p.", absolute, ")")
    ranged = _text(exhibit, "@", at, "-", end_relative, " (pp.", absolute, "-", end_absolute, ")")
    page = _text("p.", absolute)
    by_style = {"exhibit": _text("Ex. ", exhibit, "@", at), "absolute": page, "full": F.when(F.coalesce(end_absolute, F.lit(0)).isin(0) | end_absolute.eqNullSafe(absolute), single).otherwise(ranged)}[style]
    found = F.when((F.coalesce(exhibit, F.lit("")) != "") & relative.isNotNull(), by_style).otherwise(page)
    return found if bates is None else F.coalesce(F.nullif(bates, F.lit("")), found)


def resolved(exhibit: Column, relative: Column, page: Column) -> Column:
    """Ex. 1F@6 (p.105) of a page within an exhibit, p.50 of another."""
    return F.when(exhibit.isNotNull(), _text("Ex. ", exhibit, "@", relative, " (p.", page, ")")).otherwise(_text("p.", page))


def resolved_range(exhibit: Column, relative: Column, page: Column, end_exhibit: Column, end_relative: Column, end_page: Column) -> Column:
    """With the exhibit only where both ends lie in one."""
    same = exhibit.isNotNull() & exhibit.eqNullSafe(end_exhibit)
    return F.when(same, _text("Ex. ", exhibit, "@", relative, "-", end_relative, " (pp.", page, "-", end_page, ")")).otherwise(_text("pp.", page, "-", end_page))


def source(reference: Column, pages: Column, verbose: Column | None = None) -> Column:
    """Reference and page range as 1F@52-55; without a reference the verbose form made compact."""
    have, range_ = F.nullif(reference, F.lit("")), F.nullif(pages, F.lit(""))
    compact = F.coalesce(F.concat(have, F.lit("@"), range_), have)
    return compact if verbose is None else F.coalesce(compact, from_verbose(verbose))


def from_verbose(c: Column) -> Column:
    """"Ex. 1F, pp. 52-55 pp.52 of 55" as 1F@52-55."""
    short = F.replace(F.replace(c, F.lit("Ex. "), F.lit("")), F.lit(", pp. "), F.lit("@"))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(short, r"\s+pp\.\d+\s+of\s+\d+", ""), r"\s+of\s+\d+$", ""), r"^\s+|\s+$", "")
