"""Sizes as people write them: decimal units, no decimals for bytes and kilobytes, else two."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decimal units above kilobytes.
_UNITS = [("MB", 10**6), ("GB", 10**9), ("TB", 10**12), ("PB", 10**15), ("EB", 10**18)]


def human_size(size: Column) -> Column:
    text = F.when(size < 1000, F.concat(size.cast("string"), F.lit(" B")))
    text = text.when(size < 10**6, F.concat(F.round(size / 1000).cast("long").cast("string"), F.lit(" KB")))
    for name, unit in _UNITS:
        value = F.concat(F.format_string("%.2f", F.round(size.cast("double") / unit, 2)), F.lit(f" {name}"))
        text = text.when(size < unit * 1000, value) if name != "EB" else text.otherwise(value)
    return text


def parse_size(text: Column) -> Column:
    """Bytes of a text such as ``100 MB``, ``1.5GiB`` or ``4096``; b counts bytes. Null if malformed."""
    pattern = r"(?i)^\s*([0-9]+(?:\.[0-9]+)?)\s*([kmgtpe]?)(i?)b?\s*$"
    number = F.regexp_extract(text, pattern, 1).cast("double")
    power = F.position(F.lower(F.regexp_extract(text, pattern, 2)), F.lit("kmgtpe"))
    base = F.when(F.regexp_extract(text, pattern, 3) != "", 1024.0).otherwise(1000.0)
    scale = F.when(F.regexp_extract(text, pattern, 2) == "", 1.0).otherwise(F.pow(base, power))
    return F.when(text.rlike(pattern), F.floor(number * scale).cast("long"))
