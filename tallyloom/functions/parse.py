"""Tolerant parsing of run-log lines."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallyloom.functions.text import strip

# Number syntax accepted for a duration, rescue pattern, record and header prefixes.
NUMBER = (
    r"^[+-]?(?:[0-9]+(?:_[0-9]+)*(?:\.(?:[0-9]+(?:_[0-9]+)*)?)?|\.[0-9]+(?:_[0-9]+)*)"
    r"(?:[eE][+-]?[0-9]+(?:_[0-9]+)*)?$"
)
NUMBER_INSIDE = r"([0-9]+(\.[0-9]+)?)"
RECORD_LINE = r"(?iU)^[\s\x1c-\x1f]*wordcount"
HEADER_LINE = r"(?i)^benchmark"
MEASURED_LINE = r"^WordCount\s+Spark\s+"


def strict_number(text: Column) -> Column:
    """Finite number or NULL. Words such as nan or inf and type suffixes (``5d``) are not numbers here."""
    number = F.when(text.rlike(NUMBER), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))
    # The lambda binds the number, so it is parsed once.
    return F.get(F.filter(F.array(number), lambda x: F.abs(x) < float("inf")), F.lit(0))


def rescued_number(text: Column) -> Column:
    """Strict number, else the first unsigned number inside the text, else NULL."""
    return F.coalesce(strict_number(text), F.regexp_extract(text, NUMBER_INSIDE, 1).try_cast("double"))


def is_blank(line: Column) -> Column:
    return strip(line) == ""


def is_header(line: Column) -> Column:
    return line.rlike(HEADER_LINE)


def is_record(line: Column) -> Column:
    """The first field starts with the workload name, whatever its case; holds for both delimiters."""
    return line.rlike(RECORD_LINE)


def is_measured(line: Column) -> Column:
    """Case-sensitive match of the report lines written by a finished measurement."""
    return line.rlike(MEASURED_LINE)


def comma_fields(line: Column) -> Column:
    return F.transform(F.split(strip(line), ","), strip)


def blank_fields(line: Column) -> Column:
    return F.split(strip(line), "[\t ]+")
