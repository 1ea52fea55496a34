"""Time labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def freshness(at: Column, now: Column) -> Column:
    """'just now', 'Nm ago', 'Nh ago', 'Nd ago', or 'never run'."""
    seconds = F.floor((F.unix_micros(now) - F.unix_micros(at)) / 1000000)
    n = lambda size, unit: F.concat(F.floor(seconds / size).cast("string"), F.lit(unit + " ago"))
    return (F.when(at.isNull(), "never run").when(seconds < 60, "just now").when(seconds < 3600, n(60, "m"))
            .when(seconds < 86400, n(3600, "h")).otherwise(n(86400, "d")))


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 1000000


def quarter_label(at: Column) -> Column:
    """'YYYY Qn'; the session time zone is pinned to UTC."""
    return F.concat(F.year(at).cast("string"), F.lit(" Q"), F.quarter(at).cast("string"))
