"""Date and duration functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def minutes_between(start: Column, end: Column) -> Column:
    """Minute boundaries crossed from ``start`` to ``end`` (not elapsed minutes)."""
    return F.timestamp_diff(
        "MINUTE", F.date_trunc("minute", start), F.date_trunc("minute", end)
    )


def report_millis(seconds: Column) -> Column:
    """Seconds to whole milliseconds; anything not above zero counts as one."""
    return F.when(seconds > 0, (seconds * 1000).cast("bigint")).otherwise(F.lit(1).cast("bigint"))
