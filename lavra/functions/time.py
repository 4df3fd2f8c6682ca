"""Time arithmetic on timestamps without a zone (the session zone is UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(c: Column | str) -> Column:
    """Microseconds since 1970-01-01."""
    return F.unix_micros(_col(c).cast("timestamp"))


def millis(c: Column | str) -> Column:
    return F.unix_millis(_col(c).cast("timestamp"))


def seconds_between(a: Column | str, b: Column | str) -> Column:
    """Whole second boundaries crossed from ``a`` to ``b`` (0.9 s to 1.1 s counts as 1)."""
    return F.unix_seconds(_col(b).cast("timestamp")) - F.unix_seconds(_col(a).cast("timestamp"))


def hours_between(a: Column | str, b: Column | str) -> Column:
    """Fractional hours from ``a`` to ``b``."""
    return (micros(b) - micros(a)) / F.lit(3.6e9)


def from_micros(c: Column) -> Column:
    """The timestamp without zone at so many microseconds since 1970-01-01."""
    return F.timestamp_micros(c).cast("timestamp_ntz")


def bucket_start(c: Column | str, seconds: int) -> Column:
    """Start of the epoch-aligned bucket of ``seconds`` that holds the timestamp."""
    us = seconds * 1_000_000
    m = micros(c)
    return from_micros(m - F.pmod(m, F.lit(us)))
