"""Occurrences of visits whose members are objects themselves."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from chartloom.functions.text import clipped, label
from chartloom.operators.chronology import rendered
from chartloom.operators.entries import inferred_visit_type, is_empty, truthy


@dataclass(frozen=True)
class Part:
    """A labelled member: its text of up to ``most`` characters, or, of an object, the members named in ``inner``."""

    field: str
    label: str
    most: int | None = None
    inner: tuple[tuple[str, str], ...] = ()


# Layouts of the visits with nested findings, in the order in which they are shown.
CONSULTATIVE = (
    Part("history_of_complaint", "History", 300),
    Part("physical_findings", "Physical Exam", inner=(("gait_ambulation", "Gait"), ("range_of_motion", "ROM"), ("strength_neuro", "Neuro/Strength"), ("assistive_devices", "Devices"), ("general_appearance", "Appearance"))),
    Part("mental_findings", "MSE", inner=(("mood_affect", "Mood/Affect"), ("memory_concentration", "Memory"), ("thought_process", "Thought"), ("insight_judgment", "Insight"), ("appearance_behavior", "Appearance"))),
    Part("diagnostic_impression", "Impression"),
    Part("functional_opinion", "Functional Opinion", 400),
    Part("prognosis", "Prognosis"),
)
PSYCHIATRIC = (
    Part("interval_history", "History", 300),
    Part("mental_status_exam", "MSE", inner=(("mood_affect", "Mood/Affect"), ("appearance_behavior", "Appearance"), ("speech_thought", "Speech/Thought"), ("perception_cognition", "Cognition"), ("insight_judgment", "Insight"))),
    Part("risk_assessment", "Risk"),
    Part("treatment_response", "Response", 200),
    Part("plan", "Plan", 150),
)
SKIPPED = ("visit_type", "applies_to")


def _value(c: Column) -> Column:
    """A member as text: lists joined by semicolons."""
    return F.when(c.startswith("["), F.array_join(F.filter(F.coalesce(F.from_json(c, "array<string>"), F.array(c)), lambda x: truthy(x)), "; ")).otherwise(c)


def _part(occurrence: Column, part: Part) -> Column:
    member = F.element_at(occurrence, part.field)
    text = _value(member)
    if part.most:
        text = clipped(text, part.most)
    if part.inner:
        said = [F.when(truthy(F.get_json_object(member, f"$.{f}")), F.concat(F.lit(f"{name}: "), F.get_json_object(member, f"$.{f}"))) for f, name in part.inner]
        nested = F.nullif(F.concat_ws("; ", *said), F.lit(""))
        text = F.when(member.startswith("{"), nested).otherwise(text)
    return F.when(truthy(member), F.concat(F.lit(f"**{part.label}:** "), text))


def by_layout(occurrence: Column, layout: tuple[Part, ...], separator: str = "<br>", header: Column | None = None, shown: tuple[str, ...] = ()) -> Column:
    """A map of JSON texts by a layout, then its other filled members in up to 200 characters."""
    known = (*SKIPPED, *shown, *(p.field for p in layout))
    others = F.filter(F.map_entries(occurrence), lambda kv: ~kv["key"].isin(*known) & truthy(kv["value"]))
    rest = F.transform(others, lambda kv: F.concat(F.lit("**"), label(kv["key"]), F.lit(":** "), clipped(_value(kv["value"]), 200)))
    first = [header] if header is not None else []
    return F.array_join(F.concat(F.array_compact(F.array(*first, *(_part(occurrence, p) for p in layout))), rest), separator)


def consultative(occurrence: Column, separator: str = "<br>") -> Column:
    kind = F.coalesce(F.nullif(F.element_at(occurrence, "ce_type"), F.lit("")), F.lit("General"))
    who = F.nullif(F.element_at(occurrence, "examiner_specialty"), F.lit(""))
    header = F.concat(F.lit("**"), kind, F.lit(" CE**"), F.coalesce(F.concat(F.lit(" ("), who, F.lit(")")), F.lit("")))
    return by_layout(occurrence, CONSULTATIVE, separator, header, ("ce_type", "examiner_specialty"))


def occurrence_text(visit_type: Column, occurrence: Column, preview: Column | None = None, separator: str = "<br>") -> Column:
    """What a chronology shows of an entry: by its kind of visit, inferred where it is not given; entries
    without content ask for review and show up to 200 characters of the text they came from."""
    kind = F.coalesce(F.nullif(visit_type, F.lit("")), inferred_visit_type(occurrence))
    shown = F.when(kind == "consultative_exam", consultative(occurrence, separator)).when(kind == "psych_visit", by_layout(occurrence, PSYCHIATRIC, separator)).otherwise(rendered(occurrence, separator))
    asked = F.lit("**[Review Required]** Content could not be extracted.")
    if preview is not None:
        snippet = F.trim(F.replace(F.left(preview, F.lit(200)), F.lit("\n"), F.lit(" ")))
        asked = F.when(F.coalesce(preview, F.lit("")) != "", F.concat(F.lit(f"**[Review Required]** Content extraction incomplete.{separator}**Raw snippet:** "), snippet, F.lit("..."))).otherwise(asked)
    return F.when(is_empty(occurrence), asked).otherwise(F.coalesce(F.nullif(shown, F.lit("")), F.lit("—")))
