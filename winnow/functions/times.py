"""Timestamps as text (UTC, microseconds) and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc_stamp(t: Column) -> Column:
    """Fixed width, so text order is time order."""
    return F.date_format(t, "yyyyMMdd'T'HHmmss.SSSSSS'Z'")


def rfc3339(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def tenths(seconds: Column) -> Column:
    """Rounded to tenths, halves away from zero."""
    return F.round(seconds * 10) / 10
