"""Expressions on dates as typed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(c: Column) -> Column:
    """Year-month-day, month/day/year or month-day-year with a year of four digits, nothing around it; null otherwise."""
    form = lambda pattern, shape: F.when(c.rlike(shape), F.try_to_date(c, pattern))
    return F.coalesce(form("yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"), form("M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"), form("M-d-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"))


def written(c: Column) -> Column:
    """Month/day/year; empty for null."""
    return F.coalesce(F.date_format(c, "MM/dd/yyyy"), F.lit(""))
