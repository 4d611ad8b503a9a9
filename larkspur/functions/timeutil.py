"""Time helpers that do not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def _epoch_ntz() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def epoch_micros(c) -> Column:
    """Microseconds since the epoch of a timestamp_ntz (wall clock read as UTC)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.timestamp_diff("MICROSECOND", _epoch_ntz(), c)


def epoch_seconds(c) -> Column:
    return epoch_micros(c).cast("double") / F.lit(1e6)


def as_instant(c) -> Column:
    """timestamp_ntz -> timestamp (UTC instant), e.g. for watermarks."""
    return F.timestamp_micros(epoch_micros(c))


def ntz_from_epoch_seconds(epoch_s) -> Column:
    c = F.col(epoch_s) if isinstance(epoch_s, str) else epoch_s
    return F.timestamp_add("MICROSECOND", (c * F.lit(1e6)).cast("long"), _epoch_ntz())


def iso_utc(epoch_s) -> Column:
    """Epoch seconds -> ISO-8601 text (UTC wall clock, microseconds)."""
    return F.date_format(ntz_from_epoch_seconds(epoch_s), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
