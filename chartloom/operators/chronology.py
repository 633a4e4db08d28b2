"""The dated table of events and what is summed up from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.functions import dates
from chartloom.functions.text import clipped, label
from chartloom.operators.entries import truthy

LAB_MARK = "**test:**"


def combined_sources(rows: DataFrame, keys: list[str], source: str, into: str = "combined_source") -> DataFrame:
    """Sources of each key as one text: pages of an exhibit as a range from least to greatest, exhibits in
    the order of their names; sources that name no exhibit page only where none does. A single source stays as it is."""
    at = r"^(\d+F)@(\d+)"
    distinct = rows.select(*keys, F.col(source).alias("_s")).where("_s IS NOT NULL").distinct()
    exhibit = F.nullif(F.regexp_extract("_s", at, 1), F.lit(""))
    ranges = (
        distinct.withColumns({"_ex": exhibit, "_p": F.regexp_extract("_s", at, 2).try_cast("bigint")})
        .groupBy(*keys, "_ex")
        .agg(F.min("_p").alias("_a"), F.max("_p").alias("_b"), F.count("*").alias("_c"), F.sort_array(F.collect_set("_s")).alias("_all"))
    )
    text = F.concat("_ex", F.lit("@"), F.col("_a").cast("string"), F.when(F.col("_a") < F.col("_b"), F.concat(F.lit("-"), F.col("_b").cast("string"))).otherwise(""))
    summed = ranges.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(F.col("_ex").isNotNull(), F.struct("_ex", text.alias("t"))))).alias("_parsed"),
        F.first(F.when(F.col("_ex").isNull(), F.col("_all")), ignorenulls=True).alias("_other"),
        F.sum("_c").alias("_n"),
        F.first(F.element_at("_all", 1)).alias("_one"),
    )
    joined = F.when(F.size("_parsed") > 0, F.array_join(F.transform("_parsed", lambda x: x["t"]), ", ")).otherwise(F.array_join("_other", ", "))
    return summed.select(*keys, F.when(F.col("_n") == 1, F.col("_one")).otherwise(joined).alias(into))


def combined(sources: Column) -> Column:
    """The same for an array of sources: one text."""
    at = r"^(\d+F)@(\d+)"
    distinct = F.array_sort(F.array_distinct(F.array_compact(sources)))
    exhibit = lambda x: F.regexp_extract(x, at, 1)

    def summed(all_: Column) -> Column:
        parsed = F.filter(all_, lambda x: exhibit(x) != "")
        pages = lambda ex: F.transform(F.filter(parsed, lambda x: exhibit(x) == ex), lambda x: F.regexp_extract(x, at, 2).try_cast("bigint"))
        ranged = lambda ex: F.concat(ex, F.lit("@"), F.array_min(pages(ex)).cast("string"), F.when(F.array_min(pages(ex)) < F.array_max(pages(ex)), F.concat(F.lit("-"), F.array_max(pages(ex)).cast("string"))).otherwise(""))
        ranges = F.transform(F.array_sort(F.array_distinct(F.transform(parsed, exhibit))), ranged)
        return F.when(F.size(all_) == 0, F.lit(None)).when(F.size(all_) == 1, F.element_at(all_, 1)).when(F.size(ranges) > 0, F.array_join(ranges, ", ")).otherwise(F.array_join(all_, ", "))

    return F.element_at(F.transform(F.array(distinct), summed), 1)


def with_lab_panels(rows: DataFrame, scope: list[str]) -> DataFrame:
    """Lab results of one date, provider and facility as one row: texts joined in order, sources combined,
    the place in the order that of the first. Others, and single results, stay as they are.

    Rows need seq, date, provider, facility, occurrence and source.
    """
    keys = [*scope, "date", "provider", "facility"]
    lab = F.coalesce(F.lower("occurrence").contains(LAB_MARK), F.lit(False))
    panels = rows.where(lab).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", "occurrence"))).alias("_all"), F.min("seq").alias("seq"), F.collect_set("source").alias("_sources"))
    joined = panels.select(*keys, "seq", F.array_join(F.transform("_all", lambda x: x["occurrence"]), "<br><br>").alias("occurrence"), combined(F.col("_sources")).alias("source"))
    return rows.where(~lab).select(*joined.columns).unionByName(joined)


def deduplicated(rows: DataFrame, scope: list[str]) -> DataFrame:
    """The first row of each date, provider, source and first hundred characters of the occurrence."""
    by = Window.partitionBy(*scope, "date", "provider", F.left(F.coalesce("occurrence", F.lit("")), F.lit(100)), "source").orderBy("seq")
    return rows.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def processed(rows: DataFrame, scope: list[str]) -> DataFrame:
    """Lab panels, then the first of duplicates; the order is date, then seq."""
    return deduplicated(with_lab_panels(rows, scope), scope)


def footer(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, exhibit_id, citations, first_page, last_page, line, place) of each exhibit cited: distinct pages, in
    the order of exhibit numbers; pages without exhibit come last as Other Sources."""
    cited = rows.where("absolute_page IS NOT NULL").withColumn("exhibit_id", F.nullif("exhibit_id", F.lit("")))
    summed = cited.groupBy(*keys, "exhibit_id").agg(F.countDistinct("absolute_page").alias("citations"), F.min("absolute_page").alias("first_page"), F.max("absolute_page").alias("last_page"))
    name = F.when(F.col("exhibit_id").isNull(), "Other Sources").otherwise(F.concat(F.lit("Exhibit "), "exhibit_id"))
    pages = F.when(F.col("first_page") == F.col("last_page"), F.concat(F.lit("p."), F.col("first_page").cast("string"))).otherwise(F.concat(F.lit("pp."), F.col("first_page").cast("string"), F.lit("-"), F.col("last_page").cast("string")))
    number = F.regexp_extract("exhibit_id", r"^(\d+)", 1).try_cast("int")
    order = Window.partitionBy(*keys).orderBy(F.col("exhibit_id").isNull(), F.coalesce(number, F.lit(999)), F.when(number.isNull(), F.col("exhibit_id")).otherwise(F.regexp_extract("exhibit_id", r"^\d+([A-Z]*)", 1)), "exhibit_id")
    return summed.withColumns({"line": F.concat(F.lit("- **"), name, F.lit("**: "), F.col("citations").cast("string"), F.lit(" citation(s), "), pages), "place": F.row_number().over(order)})


def diagnoses(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, number, diagnosis) of the distinct diagnoses that texts list behind **Dx:**, in order."""
    listed = F.regexp_extract(text, r"(?s)\*\*Dx:\*\*(.*?)(?:\*\*|<br>|\z)", 1)
    found = rows.select(*keys, F.explode(F.split(listed, "[;,]")).alias("_d")).withColumn("diagnosis", F.trim(F.regexp_replace("_d", r"^\s+|\s+$", "")))
    kept = found.where(F.length("diagnosis") > 3).select(*keys, "diagnosis").distinct()
    return kept.withColumn("number", F.row_number().over(Window.partitionBy(*keys).orderBy("diagnosis")))


def providers(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, provider, facility): the facility of a provider's first row."""
    return rows.where("provider <> '' AND provider NOT IN ('Unknown', 'Not Specified')").groupBy(*keys, "provider").agg(F.min_by("facility", "seq").alias("facility"))


def counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Events and distinct providers, Unknown apart."""
    return rows.groupBy(*keys).agg(F.count("*").alias("events"), F.countDistinct(F.when(F.col("provider") != "Unknown", F.col("provider"))).alias("providers"))


def date_span(rows: DataFrame, keys: list[str], date: str) -> DataFrame:
    """(keys, events, dated, span): first to last date that can be read."""
    day = dates.parsed(F.col(date))
    summed = rows.groupBy(*keys).agg(F.count("*").alias("events"), F.count(day).alias("dated"), F.min(day).alias("_a"), F.max(day).alias("_b"))
    return summed.select(*keys, "events", "dated", F.when(F.col("dated") == 0, "No dated events").otherwise(F.concat(F.col("_a").cast("string"), F.lit(" to "), F.col("_b").cast("string"))).alias("span"))


def confidence(rows: DataFrame, keys: list[str], completeness: Column, provider: str, date: str) -> DataFrame:
    """Mean of completeness, providers known of five, and the share of dated rows."""
    dated = F.count_if((F.coalesce(F.col(date), F.lit("")) != "")) / F.count("*")
    summed = rows.groupBy(*keys).agg(F.max(completeness).alias("_c"), F.least(F.lit(1.0), F.countDistinct(F.nullif(provider, F.lit(""))) / 5).alias("_p"), dated.alias("_d"))
    return summed.select(*keys, ((F.col("_c") + F.col("_p") + F.col("_d")) / 3).alias("confidence"))


def rendered(occurrence: Column, separator: str = "<br>", most: int = 300) -> Column:
    """All filled members of a map of JSON texts as **Label:** value, in their order; lists and objects in one line."""
    value = lambda v: F.when(
        v.startswith("["), F.array_join(F.filter(F.coalesce(F.from_json(v, "array<string>"), F.array(v)), lambda x: truthy(x)), ", ")
    ).when(
        v.startswith("{"), F.array_join(F.transform(F.filter(F.map_entries(F.coalesce(F.from_json(v, "map<string,string>"), F.create_map(F.lit(""), v))), lambda kv: truthy(kv["value"])), lambda kv: F.concat(kv["key"], F.lit(": "), kv["value"])), "; ")
    ).otherwise(v)
    said = F.filter(F.map_entries(occurrence), lambda kv: ~kv["key"].isin("visit_type", "applies_to") & truthy(kv["value"]))
    return F.array_join(F.transform(said, lambda kv: F.concat(F.lit("**"), label(kv["key"]), F.lit(":** "), clipped(value(kv["value"]), most))), separator)


def rendered_by_template(occurrence: Column, sections: Column, separator: str = "<br>") -> Column:
    """Members in a template's order (array of field, label, max_len), then the others of up to 200 characters."""
    value = lambda v: F.when(v.startswith("["), F.array_join(F.filter(F.coalesce(F.from_json(v, "array<string>"), F.array(v)), lambda x: truthy(x)), "; ")).otherwise(v)
    first = F.filter(sections, lambda s: truthy(F.element_at(occurrence, s["field"])))
    named = F.transform(first, lambda s: F.concat(F.lit("**"), s["label"], F.lit(":** "), F.when(F.length(value(F.element_at(occurrence, s["field"]))) > s["max_len"], F.concat(F.left(value(F.element_at(occurrence, s["field"])), s["max_len"]), F.lit("..."))).otherwise(value(F.element_at(occurrence, s["field"])))))
    left = F.filter(F.map_entries(occurrence), lambda kv: ~kv["key"].isin("visit_type", "applies_to") & truthy(kv["value"]) & ~F.exists(sections, lambda s: s["field"] == kv["key"]))
    rest = F.transform(left, lambda kv: F.concat(F.lit("**"), label(kv["key"]), F.lit(":** "), clipped(value(kv["value"]), 200)))
    return F.array_join(F.concat(named, rest), separator)


def markdown_table(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, markdown): the events of each key as a table in order of date and seq, pipes escaped."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    line = F.concat(F.lit("| "), dates.written(F.col("date")), F.lit(" | "), cell("provider"), F.lit(" | "), cell("facility"), F.lit(" | "), cell("occurrence"), F.lit(" | "), cell("source"), F.lit(" |"))
    head = "| Date | Provider | Facility | Occurrence | Source |\n|------|----------|----------|------------|--------|\n"
    body = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("date", "seq", line.alias("l")))).alias("_l"))
    return body.select(*keys, F.concat(F.lit(head), F.array_join(F.transform("_l", lambda x: x["l"]), "\n")).alias("markdown"))


def html_rows(rows: DataFrame) -> DataFrame:
    """Adds ``html``: the event as a table row, signs escaped."""
    from chartloom.functions.text import escaped_html

    cell = lambda c: F.concat(F.lit("<td>"), escaped_html(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>"))
    return rows.withColumn("html", F.concat(F.lit("<tr>"), F.concat(F.lit("<td>"), dates.written(F.col("date")), F.lit("</td>")), cell("provider"), cell("facility"), cell("occurrence"), cell("source"), F.lit("</tr>")))
