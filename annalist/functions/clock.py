"""Clock stamps and their text forms.

Times are kept as TIMESTAMP_NTZ holding UTC wall-clock, so no result depends on
the session's time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc_now() -> Column:
    return F.expr("convert_timezone(current_timezone(), 'UTC', localtimestamp())")


def stamp(clock: Column | None) -> Column:
    """The given clock column, or the query's start time when there is none."""
    return utc_now() if clock is None else clock.cast("timestamp_ntz")


def rfc3339(ts: Column) -> Column:
    """``2024-01-01T00:00:07.1795Z``: trailing zeros of the fraction are dropped."""
    text = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(text, r"\.?0+$", ""), F.lit("Z"))


def trace_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS")
