"""Dates as epoch seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from xmseq.model import DATE_FORMAT


def epoch_seconds(col: Column | str, strict: bool = True) -> Column:
    """Seconds from 1970-01-01 to midnight UTC of a date, whatever the session zone.

    Text must be yyyy-MM-dd: a bad one raises, or gives NULL with strict=False.
    """
    parse = F.to_date if strict else F.try_to_date
    return days_to_seconds(parse(col, DATE_FORMAT))


def days_to_seconds(day: Column | str) -> Column:
    """The same for a date or timestamp column."""
    day = F.col(day) if isinstance(day, str) else day
    return F.datediff(day.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint") * F.lit(86400)
