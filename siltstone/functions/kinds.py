"""Kinds of entries and codes of metadata changes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Type bits of a POSIX mode, and Windows attribute bits.
_TYPE_BITS, _LINK, _DIRECTORY, _FILE = 0o170000, 0o120000, 0o040000, 0o100000
_REPARSE, _WINDOWS_DIRECTORY = 0x400, 0x10


def kind_of_mode(mode: Column) -> Column:
    """symlink, directory or file; null for sockets, devices and pipes."""
    bits = mode.cast("long").bitwiseAND(F.lit(_TYPE_BITS).cast("long"))
    return F.when(bits == _LINK, "symlink").when(bits == _DIRECTORY, "directory").when(bits == _FILE, "file")


def kind_of_attributes(attributes: Column) -> Column:
    bits = attributes.cast("long")
    return F.when(bits.bitwiseAND(F.lit(_REPARSE).cast("long")) != 0, "symlink").when(
        bits.bitwiseAND(F.lit(_WINDOWS_DIRECTORY).cast("long")) != 0, "directory",
    ).otherwise("file")


#: Fields of the metadata struct, all nullable.
META = "meta_type string, mode long, size long, uid long, gid long, atime_ns long, mtime_ns long, attributes long, creation_ns long"


def metadata_code(left: Column, right: Column) -> Column:
    """How metadata changed: O owner, P permissions, T modification, A access, M else; null if not.

    ``left`` and ``right`` are structs with the fields of ``META``; nulls are compared as values.
    """

    def differs(*names: str) -> Column:
        out = F.lit(False)
        for n in names:
            out = out | ~left[n].eqNullSafe(right[n])
        return out

    every = differs(*[f.split()[0] for f in META.split(", ")])
    posix = (left["meta_type"] == "posix") & (right["meta_type"] == "posix")
    return (
        F.when(~every, None)
        .when(~F.coalesce(posix, F.lit(False)), "M")
        .when(differs("uid", "gid"), "O")
        .when(differs("mode"), "P")
        .when(differs("mtime_ns"), "T")
        .when(differs("atime_ns"), "A")
        .otherwise("M")
    )
