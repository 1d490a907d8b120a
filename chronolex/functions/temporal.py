"""The strict time rule as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STATUSES = ("eligible", "same_year_unresolved", "ineligible", "missing_temporal_metadata")


def year_of_text(value: Column) -> Column:
    """Year of a date string: four leading digits, else the end of d-m-yyyy or d/m/yyyy."""
    trimmed = F.trim(value)
    late = F.regexp_extract(trimmed, r"^\d{1,2}[-/]\d{1,2}[-/](\d{4})$", 1)
    return F.when(trimmed.rlike(r"^\d{4}"), F.substring(trimmed, 1, 4).cast("int")).when(late != "", late.cast("int"))


def status(query_year: Column, source_year: Column) -> Column:
    """Which of STATUSES a source has for a query; only strictly earlier years are eligible."""
    return (
        F.when(query_year.isNull() | source_year.isNull(), STATUSES[3])
        .when(source_year < query_year, STATUSES[0])
        .when(source_year == query_year, STATUSES[1])
        .otherwise(STATUSES[2])
    )
