"""Reports: sections of a case as lines, Markdown, JSON and files."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions import dates


@dataclass(frozen=True)
class Section:
    """Title, columns, the lines of a case without rows, and a note above the table. Without columns, rows are items of a list."""

    title: str
    columns: tuple[str, ...]
    nothing: str
    note: str = ""

    def head(self, number: int) -> str:
        """Everything above the rows; each column's dashes are as long as its title."""
        lines = [f"## SECTION {number}: {self.title.upper()}", ""]
        lines += [self.note, ""] if self.note else []
        if self.columns:
            lines += [f"| {' | '.join(f'**{c}**' for c in self.columns)} |", f"|{'|'.join('-' * (len(c) + 6) for c in self.columns)}|"]
        return "\n".join(lines)


# Sections of a report, in their order.
SECTIONS = (
    Section("Claimant Identification", ("Field", "Value", "Field", "Value"), "| N/A | N/A | N/A | N/A |"),
    Section("Administrative Data & Critical Dates", ("Case Information", "Value", "Denial Dates", "Date"), "| N/A | N/A | N/A | N/A |"),
    Section("Alleged Impairments Inventory", ("Alleged Condition", "Source"), "| No alleged impairments documented | N/A |", "**Note: Extract claimant's own words from forms - do not interpret**"),
    Section("Medically Determinable Impairments", ("Confirmed Diagnosis", "ICD Code", "Severity", "First Documented", "Source"), "| No MDIs documented | N/A | N/A | N/A | N/A |"),
    Section("Medical Source Opinions", ("Date", "Medical Source", "Relationship", "Opinion Type", "Source"), "| N/A | No medical source opinions documented | N/A | N/A | N/A |"),
    Section("Surgical History Inventory", ("Date", "Procedure", "Facility Type", "Source"), "| N/A | No surgical history documented | N/A | N/A |"),
    Section("Diagnostic Testing Summary", ("Date", "Test", "Category", "Results (Succinct)", "Source"), "| N/A | No diagnostic tests documented | N/A | N/A | N/A |"),
    Section("Current Medication Profile", ("Medication", "Dosage", "Frequency", "Indication", "Source"), "| No medications documented | N/A | N/A | N/A | N/A |"),
    Section("Occupational History Profile", ("Position Title", "Employment Period", "Exertional Level", "Source"), "| No occupational history documented | N/A | N/A | N/A |"),
    Section("Functional Capacity Indicators", ("Activity Domain", "Reported Limitation", "Specific Examples", "Source"), "| No functional limitations documented | N/A | N/A | N/A |", "**Note: Claimant statements only - extract from Section E forms**"),
    Section("Missing Medical Evidence", (), "No significant gaps in medical evidence identified."),
    Section("Comprehensive Patient History Medical Evidence Table", ("DOS", "Provider", "Facility", "Occurrence/Treatment", "Source"), "| N/A | No medical events documented | N/A | N/A | N/A |"),
)
# Lines of the first two sections, as label and member.
CLAIMANT_LINES = ((("Full Name", "full_name"), ("SSN", "ssn")), (("Date of Birth", "date_of_birth"), ("BNC Code", "bnc_code")), (("Case File Reference", "case_file_reference"), ("Total Document Pages", "total_document_pages")))
ADMINISTRATIVE_LINES = (
    (("Claim Type", "claim_type"), ("Initial Denial", "initial_denial_date")),
    (("Protective Filing Date (PFD)", "protective_filing_date"), ("Reconsideration Denial", "reconsideration_denial_date")),
    (("Alleged Onset Date (AOD)", "alleged_onset_date"), ("ALJ Hearing Date", "alj_hearing_date")),
    (("Date Last Insured (DLI)", "date_last_insured"), None),
)
#: Place of a section's head and of what stands in for its rows.
HEAD, NOTHING = -2, -1


def _cell(c: Column) -> Column:
    return F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))


def _or_na(c: Column) -> Column:
    return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("N/A"))


def _day(name: str, missing: str = "N/A") -> Column:
    return F.coalesce(F.nullif(dates.written(F.col(name)), F.lit("")), F.lit(missing))


def _table_line(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *map(_cell, cells)), F.lit(" |"))


def _grid(df: DataFrame, number: int, lines: tuple, values: dict[str, Column]) -> DataFrame:
    """Two labels and values a line. Where a case has several such records, they follow each other."""
    half = lambda x: [F.lit(f"**{x[0]}**"), values[x[1]]] if x else [F.lit("")] * 2
    made = F.array(*(F.struct(F.lit(i).cast("long").alias("i"), _table_line(*half(a), *half(b)).alias("line")) for i, (a, b) in enumerate(lines)))
    return df.select("case_id", F.lit(number).alias("section"), F.col("_place").cast("long").alias("_p"), F.explode(made).alias("l")).select("case_id", "section", (F.col("_p") * len(lines) + F.col("l.i")).alias("place"), "l.line")


@dataclass
class ReportBuilder:
    """Collects sections; each may be given in several parts. Nothing runs until the report is written."""

    cases: DataFrame
    parts: list[DataFrame] = field(default_factory=list)

    def add(self, df: DataFrame, title: str, place: Column | str, *cells: Column) -> ReportBuilder:
        """A section's rows from any table that has case_id: cells in the order of its columns."""
        number = next(i for i, s in enumerate(SECTIONS) if s.title == title)
        columns = SECTIONS[number].columns
        if len(cells) != max(len(columns), 1):
            raise ValueError(f"{title} has {len(columns)} columns")
        line = _table_line(*cells) if columns else F.concat(F.lit("- "), cells[0])
        self.parts.append(df.select("case_id", F.lit(number).alias("section"), (F.col(place) if isinstance(place, str) else place).cast("long").alias("place"), line.alias("line")))
        return self

    def claimants(self, df: DataFrame) -> ReportBuilder:
        from chartloom.functions.text import masked_ssn

        values = {"full_name": F.col("full_name"), "ssn": F.when(F.coalesce("ssn", F.lit("")) != "", masked_ssn(F.col("ssn"))).otherwise("N/A"), "date_of_birth": _day("date_of_birth", ""), "bnc_code": _or_na(F.col("bnc_code")), "case_file_reference": F.col("case_file_reference"), "total_document_pages": F.col("total_document_pages")}
        self.parts.append(_grid(df.withColumn("_place", F.col("claimant_id") if "claimant_id" in df.columns else F.lit(0)), 0, CLAIMANT_LINES, values))
        return self

    def administrative(self, df: DataFrame) -> ReportBuilder:
        """One row a case: claim_type and the dates of ADMINISTRATIVE_LINES."""
        named = [x[1] for line in ADMINISTRATIVE_LINES for x in line if x]
        self.parts.append(_grid(df.withColumn("_place", F.lit(0)), 1, ADMINISTRATIVE_LINES, {n: F.col(n) if n == "claim_type" else _day(n) for n in named}))
        return self

    def alleged(self, df: DataFrame, place: Column | str) -> ReportBuilder:
        return self.add(df, SECTIONS[2].title, place, F.col("condition_name"), F.col("source"))

    def impairments(self, df: DataFrame, place: Column | str = "diagnosis_id") -> ReportBuilder:
        return self.add(df, SECTIONS[3].title, place, F.col("diagnosis"), _or_na(F.col("icd_code")), _or_na(F.col("severity")), _day("first_documented"), F.col("source"))

    def opinions(self, df: DataFrame, place: Column | str) -> ReportBuilder:
        return self.add(df, SECTIONS[4].title, place, _day("date", ""), F.col("medical_source"), F.col("relationship"), F.col("opinion_type"), F.col("source"))

    def surgeries(self, df: DataFrame, place: Column | str) -> ReportBuilder:
        return self.add(df, SECTIONS[5].title, place, _day("date", ""), F.col("procedure"), F.col("facility_type"), F.col("source"))

    def tests(self, df: DataFrame, place: Column | str) -> ReportBuilder:
        return self.add(df, SECTIONS[6].title, place, _day("date", ""), F.col("test_name"), _or_na(F.col("category")), F.col("results_summary"), F.col("source"))

    def medications(self, df: DataFrame, place: Column | str) -> ReportBuilder:
        return self.add(df, SECTIONS[7].title, place, F.col("medication"), _or_na(F.col("dosage")), _or_na(F.col("frequency")), _or_na(F.col("indication")), F.col("source"))

    def occupations(self, df: DataFrame, place: Column | str) -> ReportBuilder:
        return self.add(df, SECTIONS[8].title, place, F.col("position_title"), F.col("employment_period"), _or_na(F.col("exertional_level")), F.col("source"))

    def limitations(self, df: DataFrame, place: Column | str) -> ReportBuilder:
        return self.add(df, SECTIONS[9].title, place, F.col("activity_domain"), F.col("reported_limitation"), _or_na(F.col("specific_examples")), F.col("source"))

    def gaps(self, df: DataFrame, place: Column | str) -> ReportBuilder:
        period = F.nullif(F.col("time_period"), F.lit(""))
        said = F.coalesce("gap_description", F.lit("Unknown gap"))
        return self.add(df, SECTIONS[10].title, place, F.coalesce(F.concat(said, F.lit(" ("), period, F.lit(")")), said))

    def chronology(self, df: DataFrame) -> ReportBuilder:
        # Sorted by date, then by the order of extraction.
        place = F.unix_date("date").cast("long") * F.lit(1 << 32) + F.col("seq")
        shown = F.coalesce(F.nullif(F.col("occurrence"), F.lit("")), F.lit("—"))
        return self.add(df, SECTIONS[11].title, place, dates.written(F.col("date")), F.col("provider"), F.col("facility"), shown, F.col("source"))

    def _rows(self) -> DataFrame | None:
        rows = None
        for part in self.parts:
            rows = part if rows is None else rows.unionByName(part)
        return rows

    def lines(self) -> DataFrame:
        """(case_id, section, place, line): the heads of all sections of all cases, their rows, and what stands in
        where there are none. Sorted by case, section and place they are the report; no case is gathered."""
        heads = F.array(*(F.struct(F.lit(i).alias("section"), F.lit(s.head(i + 1)).alias("head"), F.lit(s.nothing).alias("nothing")) for i, s in enumerate(SECTIONS)))
        frame = self.cases.select("case_id").distinct().select("case_id", F.explode(heads).alias("s")).select("case_id", "s.*")
        head = frame.select("case_id", "section", F.lit(HEAD).cast("long").alias("place"), F.col("head").alias("line"))
        rows = self._rows()
        bare = frame if rows is None else frame.join(rows.select("case_id", "section").distinct(), ["case_id", "section"], "left_anti")
        nothing = bare.select("case_id", "section", F.lit(NOTHING).cast("long").alias("place"), F.col("nothing").alias("line"))
        both = head.unionByName(nothing)
        # Rows of cases that the report isn't about stay out.
        return both if rows is None else both.unionByName(rows.join(self.cases.select("case_id").distinct(), "case_id", "left_semi"))

    def sections(self) -> DataFrame:
        """(case_id, section, lines, markdown): each section in one text; for cases that a reader takes in at once."""
        all_ = self.lines().groupBy("case_id", "section").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("l"), F.count_if(F.col("place") > NOTHING).cast("int").alias("lines"))
        return all_.select("case_id", "section", "lines", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("markdown"))

    def markdown(self) -> DataFrame:
        """(case_id, report): the whole report of each case."""
        parts = self.sections().groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("section", "markdown"))), lambda x: x["markdown"]).alias("p"))
        return parts.select("case_id", F.concat(F.lit("# MEDICAL CHRONOLOGY\n\n**Case:** "), "case_id", F.lit("\n\n"), F.array_join("p", "\n\n---\n\n"), F.lit("\n")).alias("report"))

    def json(self) -> DataFrame:
        """(case_id, report): the sections as JSON."""
        rows = self.sections().groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("section", "lines", "markdown"))).alias("sections"))
        return rows.select("case_id", F.to_json(F.struct(F.lit("2.0.0").alias("schema_version"), "case_id", "sections")).alias("report"))


def entry_block(date: Column, event_type: Column, provider: Column, facility: Column, citation: Column, description: Column) -> Column:
    """An event as a block of Markdown: date as heading, kind, provider and facility, source, description; what is missing is left out."""
    filled = lambda c: F.nullif(c, F.lit(""))
    # A date that is empty is shown as such, only a missing one is named unknown.
    parts = [
        F.concat(F.lit("### "), F.coalesce(date, F.lit("Unknown Date")), F.lit("\n")),
        F.concat(F.lit("**"), filled(event_type), F.lit("**\n")),
        F.concat(filled(F.concat_ws(" - ", filled(provider), filled(facility))), F.lit("\n")),
        F.concat(F.lit("**Source:** "), filled(citation), F.lit("\n")),
        F.concat(filled(description), F.lit("\n")),
    ]
    return F.concat_ws("\n", *parts)


def write_reports(reports: DataFrame, path: str) -> None:
    """A folder for each case with the text of its report."""
    reports.select("case_id", F.col("report").alias("value")).write.mode("overwrite").partitionBy("case_id").text(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """Reports of cases of any size: a folder a case whose files, in the order of their names, hold its lines in order.

    A range partitioning spreads a large case over several tasks and files."""
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = lines.repartitionByRange(n, "case_id", "section", "place").sortWithinPartitions("case_id", "section", "place")
    placed.select("case_id", F.col("line").alias("value")).write.mode("overwrite").partitionBy("case_id").text(path)
