"""Dates, stamps and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_date(text: Column, pattern: str = "yyyy-MM-dd") -> Column:
    """Null for text that is not a date."""
    return F.try_to_date(text, pattern)


def month_label(date: Column) -> Column:
    return F.date_format(date, "MMM yyyy")


def dated_name(date: Column, suffix: str) -> Column:
    return F.concat(F.date_format(date, "yyyyMMdd"), F.lit(f"_{suffix}"))


def run_started_at(filename: Column) -> Column:
    """Start of a run from its log name, e.g. `2024-11-05T11-14-52-05-00_task_id.json`."""
    stamp = F.regexp_extract(
        filename, r"^(\d{4}-\d{2}-\d{2}T\d{2}-\d{2}-\d{2}[+-]\d{2}-\d{2})_", 1
    )
    iso = F.regexp_replace(stamp, r"T(\d{2})-(\d{2})-(\d{2})([+-]\d{2})-(\d{2})$", "T$1:$2:$3$4:$5")
    return F.try_to_timestamp(iso, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))


def offset_timestamp(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))


def run_duration(filename: Column, finished: Column) -> Column:
    """Seconds from the start stamp in the log name to the end of the run."""
    return F.timestamp_diff("SECOND", run_started_at(filename), finished)
