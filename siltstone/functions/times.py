"""Times in nanoseconds since the epoch, as long; Spark's timestamps only hold microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds from 1601 to 1970.
_FILETIME_EPOCH = 11_644_473_600


def _floor_div(a: Column, n: int) -> Column:
    """Quotient rounded down, in whole numbers."""
    return F.call_function("div", a - F.pmod(a, F.lit(n)), F.lit(n))


def to_timestamp(ns: Column) -> Column:
    return F.timestamp_micros(_floor_div(ns.cast("long"), 1000))


def to_text(ns: Column) -> Column:
    """ISO text in UTC with nine decimals."""
    second, rest = _floor_div(ns.cast("long"), 1_000_000_000), F.pmod(ns.cast("long"), F.lit(1_000_000_000))
    return F.concat(F.date_format(F.timestamp_seconds(second), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad(rest.cast("string"), 9, "0"), F.lit("Z"))


def display(ns: Column) -> Column:
    """Weekday, month, day, year and time, for people."""
    return F.date_format(F.timestamp_seconds(_floor_div(ns.cast("long"), 1_000_000_000)), "EEE MMM d yyyy HH:mm:ss")


def parse(text: Column) -> Column:
    """Nanoseconds of a zoned text (``2024-01-01T00:00:00.5+01:00[Europe/Paris]`` or with ``Z``); null if malformed."""
    bare = F.regexp_replace(text, r"\[[^\]]*\]$", "")
    fraction = F.rpad(F.regexp_extract(bare, r"\.([0-9]{1,9})", 1), 9, "0").cast("long")
    whole = F.try_to_timestamp(F.regexp_replace(bare, r"\.[0-9]+", ""))
    return F.unix_seconds(whole) * 1_000_000_000 + fraction


def from_filetime(ticks: Column) -> Column:
    """Nanoseconds of a count of 100 ns since 1601; 0 means none."""
    return F.when(ticks != 0, (ticks - _FILETIME_EPOCH * 10_000_000) * 100)
