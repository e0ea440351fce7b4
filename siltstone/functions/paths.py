"""Paths as arrays of components, so that order is by component (``a/b`` before ``a.txt``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(path: Column) -> Column:
    """Components of a path; empty ones (doubled or trailing slashes) are left out, a root slash too."""
    return F.filter(F.split(path, "/"), lambda x: x != "")


def join_parts(components: Column) -> Column:
    return F.array_join(components, "/")


def last_component(path: Column) -> Column:
    return F.try_element_at(parts(path), F.lit(-1))


def has_trailing_slash(path: Column) -> Column:
    return path.endswith("/")


def with_trailing_slash(path: Column) -> Column:
    return F.when(has_trailing_slash(path), path).otherwise(F.concat(path, F.lit("/")))


def strip_prefix(path: Column, prefix: Column) -> Column:
    """Path relative to ``prefix`` by components; null if it is not below it."""
    a, b = parts(path), parts(prefix)
    inside = F.slice(a, F.lit(1), F.greatest(F.size(b), F.lit(0))) == b
    return F.when(inside, join_parts(F.slice(a, F.size(b) + 1, F.greatest(F.size(a), F.lit(1)))))


def ancestors(path: Column) -> Column:
    """All prefixes of a path by component, itself included; absolute paths keep their slash."""
    lead = F.when(path.startswith("/"), "/").otherwise("")
    p = parts(path)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(p), F.lit(1))), lambda n: F.concat(lead, join_parts(F.slice(p, F.lit(1), n))))


def is_plain_relative(path: Column) -> Column:
    """Whether a path may be looked up in a tree: relative, and without ``..``."""
    return ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), "..")


def destination(name: Column) -> Column:
    """Key of an object by its extension: packs, indexes or snapshots; null for others."""
    kind = F.element_at(F.split(name, r"\."), -1)
    prefix = F.when(kind == "pack", "packs/").when(kind == "index", "indexes/").when(kind == "snapshot", "snapshots/")
    return F.concat(prefix, name)


def id_from_path(path: Column) -> Column:
    """The id that a file's stem spells."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
