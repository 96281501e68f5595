"""Times written as YYYYMMDDTHHMMSS.f with one to six digits of the fraction, in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN = "yyyyMMdd'T'HHmmss.SSSSSS"


def parse_time(text: Column) -> Column:
    """A timestamp, or null if the text has another form."""
    return F.try_to_timestamp(text, F.lit(PATTERN))


def weekday(time: Column) -> Column:
    """Three letters, Mon to Sun."""
    return F.date_format(time, "E")


def hours_between(enter: Column, leave: Column) -> Column:
    """Hours from enter to leave; 0 if either is missing or leave isn't later."""
    micros = F.unix_micros(leave.cast("timestamp")) - F.unix_micros(enter.cast("timestamp"))
    return F.when(micros > 0, micros / F.lit(3.6e9)).otherwise(F.lit(0.0))
