"""Exhibits routed by rules: which template reads them, whether they are read at all, and by which means."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _holds(title: Column, patterns: tuple[str, ...]) -> Column:
    """Whether a title holds one of several texts, in any case."""
    if not patterns:
        return F.lit(False)
    return F.coalesce(title.rlike("(?i)" + "|".join(map(re.escape, patterns))), F.lit(False))


@dataclass(frozen=True)
class TitleRules:
    """Templates by what titles hold, in the order in which they are tried; each may be restricted to sections."""

    rules: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...]
    default: str = "office_visit"
    by_section: dict[str, str] = field(default_factory=dict)
    skipped: tuple[str, ...] = ()

    @classmethod
    def of(cls, config: dict) -> TitleRules:
        """From a mapping file as read: default_template, section_defaults, mappings and skip_patterns."""
        rules = tuple((name, tuple(map(str, c.get("patterns") or ())), tuple(c.get("sections") or ())) for name, c in (config.get("mappings") or {}).items())
        return cls(rules, config.get("default_template", "office_visit"), dict(config.get("section_defaults") or {}), tuple(map(str, (config.get("skip_patterns") or {}).get("patterns") or ())))

    def template(self, title: Column, section: Column) -> Column:
        """The first rule whose sections and texts fit, else the section's default, else the default; null where the title is skipped."""
        found = F.lit(self.default)
        for name, template in self.by_section.items():
            found = F.when(section == name, template).otherwise(found)
        for template, patterns, sections in reversed(self.rules):
            fits = _holds(title, patterns)
            found = F.when(fits & section.isin(*sections) if sections else fits, template).otherwise(found)
        return F.when(~_holds(title, self.skipped), found)


@dataclass(frozen=True)
class SectionRule:
    """What of a section is read: its latest exhibits, all, none, or those of some categories."""

    include: bool = True
    latest: int | None = None
    categories: tuple[str, ...] | None = None
    excluded: tuple[str, ...] = ()

    @classmethod
    def of(cls, config: dict) -> SectionRule:
        categories = config.get("categories") or {}
        only = tuple(categories.get("include") or ()) if config.get("strategy") == "category_filter" else None
        return cls(bool(config.get("include", True)), config.get("latest_n") if config.get("strategy") == "latest_n" else None, only, tuple(categories.get("exclude") or ()))


def category(title: Column, patterns: dict[str, tuple[str, ...]]) -> Column:
    """The first category one of whose texts a title holds; null without."""
    found = F.lit(None).cast("string")
    for name, texts in reversed(patterns.items()):
        found = F.when(_holds(title, texts), name).otherwise(found)
    return found


def selected(exhibits: DataFrame, rules: dict[str, SectionRule], patterns: dict[str, tuple[str, ...]]) -> DataFrame:
    """The exhibits (case_id, section, title, page_start, ord) that are read, with their category.

    Sections without a rule are left out. Of a section with ``latest``, each case's exhibits that start last are
    kept; the limit is the feature. Categories left out are left out before the latest are taken.
    """
    rows = exhibits.withColumn("category", category(F.col("title"), patterns))
    kept = F.lit(False)
    for section, rule in rules.items():
        fits = F.lit(rule.include) & ~F.coalesce(F.col("category").isin(*rule.excluded), F.lit(False))
        if rule.categories is not None:
            fits = fits & F.coalesce(F.col("category").isin(*rule.categories), F.lit(False))
        kept = kept | ((F.col("section") == section) & fits)
    rows = rows.where(kept)
    latest = {s: r.latest for s, r in rules.items() if r.latest is not None}
    if not latest:
        return rows
    n = F.row_number().over(Window.partitionBy("case_id", "section").orderBy(F.desc("page_start"), "ord"))
    limited = rows.where(F.col("section").isin(*latest)).withColumn("_n", n)
    most = F.lit(None).cast("int")
    for section, k in latest.items():
        most = F.when(F.col("section") == section, k).otherwise(most)
    return rows.where(~F.col("section").isin(*latest)).unionByName(limited.where((F.col("_n") <= max(latest.values())) & (F.col("_n") <= most)).drop("_n"))


# Kinds of files, and what isn't done with each.
WITHOUT = {"court_transcript": ("text",), "processed": ("vision", "recovery"), "raw_ssa": ()}


def allowed(rows: DataFrame, formats: DataFrame, means: str) -> DataFrame:
    """Rows of the cases whose files are read by ``means`` (text, vision or recovery); a case without a known format is."""
    barred = [f for f, left_out in WITHOUT.items() if means in left_out]
    return rows.join(formats.where(F.col("format").isin(*barred)).select("case_id").distinct(), "case_id", "left_anti") if barred else rows
