"""Media timecodes HH:MM:SS.mmm."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_timecode(seconds: Column) -> Column:
    """Seconds, rounded to milliseconds, may show as 60.000."""
    s = seconds.cast("double")
    hours, minutes = F.floor(s / 3600), F.floor((s % 3600) / 60)
    return F.format_string("%02d:%02d:%06.3f", hours, minutes, s % 60)


def parse_timecode(text: Column) -> Column:
    """Seconds of a timecode; 0 for anything else, and never negative."""
    p = F.split(text, ":")
    hours, minutes, seconds = (F.get(p, F.lit(i)).try_cast(t) for i, t in enumerate(("int", "int", "double")))
    value = F.when(F.size(p) == 3, hours * 3600 + minutes * 60 + seconds)
    return F.greatest(F.lit(0.0), F.coalesce(value, F.lit(0.0)))


def parse_timecode_strict(text: Column) -> Column:
    """As above, but digits that don't parse raise an error; other than three parts give 0."""
    p = F.split(text, ":")
    value = F.get(p, F.lit(0)).cast("int") * 3600 + F.get(p, F.lit(1)).cast("int") * 60 + F.get(p, F.lit(2)).cast("double")
    return F.when(F.size(p) == 3, value).otherwise(F.lit(0.0))
