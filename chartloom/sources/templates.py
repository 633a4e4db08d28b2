"""Templates of visit types: YAML files as a small table."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

FIELDS = "visit_type STRING, field STRING, place INT, label STRING, type STRING, max_len INT, required BOOLEAN"
# Files beside the templates that are none.
NO_TEMPLATES = ("base", "exhibit_type_mapping", "README")


def first_existing(*paths: str | Path) -> Path | None:
    """The first of several places that exists."""
    return next((p for p in map(Path, paths) if p.exists()), None)


def load(path: str | Path) -> dict:
    """A YAML file; empty where there is none."""
    try:
        import yaml
    except ImportError as missing:
        raise RuntimeError("templates need PyYAML") from missing
    place = Path(path)
    return (yaml.safe_load(place.read_text()) or {}) if place.exists() else {}


def ordered(fields: dict, labels: list[str]) -> list[str]:
    """Field names in the order of the output's labels, then the rest; of fields that share a label the last counts."""
    by_label = {c.get("label"): name for name, c in fields.items() if c.get("label")}
    first = [by_label[label] for label in labels if label in by_label]
    return list(dict.fromkeys([*first, *fields]))


def fields(spark: SparkSession, folder: str | Path) -> DataFrame:
    """Fields of all templates of a folder, in order. A handful of rows a visit type."""
    rows = []
    for path in sorted(Path(folder).glob("*.yaml")):
        if path.stem in NO_TEMPLATES:
            continue
        template = load(path)
        known = template.get("fields") or {}
        for place, name in enumerate(ordered(known, template.get("output_labels") or [])):
            c = known[name] or {}
            rows.append((path.stem, name, place, c.get("label", name.replace("_", " ").title()), c.get("type", "string"), c.get("max_len"), bool(c.get("required"))))
    return spark.createDataFrame(rows, FIELDS)
