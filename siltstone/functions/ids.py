"""Content ids: SHA-224 of bytes, shown as 45 symbols of lower-case base32hex."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ID_LENGTH = 45


def digest(content: Column, bits: int = 224) -> Column:
    """SHA-2 digest as hex text."""
    return F.sha2(content.cast("binary"), bits)


def checksum(content: Column) -> Column:
    """SHA-1 as hex text, as object stores want it with an upload."""
    return F.sha1(content.cast("binary"))


def base32(hex_digest: Column) -> Column:
    """Base32hex text of a 224-bit hex digest: 20 bits (5 hex digits, 4 symbols) at a time; the last
    hex digit and a zero bit make the 45th symbol."""
    groups = [F.lpad(F.lower(F.conv(F.substring(hex_digest, 1 + 5 * i, 5), 16, 32)), 4, "0") for i in range(11)]
    last = F.lower(F.conv((F.conv(F.substring(hex_digest, 56, 1), 16, 10).cast("int") * 2).cast("string"), 10, 32))
    return F.concat(*groups, last)


def object_id(content: Column) -> Column:
    """The id of a blob's bytes."""
    return base32(digest(content))


def is_id(text: Column) -> Column:
    """Whether a text is an id: right length, right symbols (no capitals), pad bit zero."""
    return text.rlike(r"\A[0-9a-v]{44}[02468acegikmoqsu]\z")


def base32_to_hex(text: Column) -> Column:
    """Hex digest of an id; null for text that is none."""
    groups = [F.lpad(F.lower(F.conv(F.substring(text, 1 + 4 * i, 4), 32, 16)), 5, "0") for i in range(11)]
    last = F.lower(F.conv(F.floor(F.conv(F.substring(text, 45, 1), 32, 10).cast("int") / 2).cast("string"), 10, 16))
    return F.when(is_id(text), F.concat(*groups, last))


def short_id(text: Column) -> Column:
    return F.left(text, F.lit(8))
