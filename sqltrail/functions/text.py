"""Small text helpers shared by views and sinks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def comma_list(values: Column) -> Column:
    return F.concat_ws(", ", values)


def filter_calculation(locations: Column) -> Column:
    """M6: usage places without ``calculation``, in any case."""
    return F.filter(locations, lambda place: F.lower(place) != "calculation")


def escape_formula_text(text: Column) -> Column:
    """K6: a cell a spreadsheet would run as a formula gets a leading backtick."""
    return F.when(text.rlike(r"\A[=\-+@]"), F.concat(F.lit("`"), text)).otherwise(text)


def escape_source_text(sql: Column) -> Column:
    """K6 for the source statement: no leading newlines, always a leading backtick."""
    body = F.regexp_replace(sql, r"\A\n++", "")
    return F.when(body.startswith("`"), body).otherwise(F.concat(F.lit("`"), body))


def sorted_set(values: Column) -> Column:
    """Distinct, non-empty values in code point order."""
    return F.array_sort(F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != ""))))
