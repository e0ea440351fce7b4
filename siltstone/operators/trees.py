"""Directory trees as rows: unfolding, cycles, listings, descent, and Merkle roll-ups.

Trees are rows (tree_id, name, kind, chunks, subtree, target, meta). Unfolding goes level by level: a
level is one join, written before the next, so plans stay small and lost executors cost little. The
number of rounds is the depth of the hierarchy, not its size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cbor import object_id, tree_bytes
from ..functions.kinds import META
from ..scratch import materialize

TREE = f"tree_id string, name string, kind string, chunks array<string>, subtree string, target string, meta struct<{META.replace(' ', ':').replace(',:', ',')}>"


class CycleError(ValueError):
    """A directory that holds itself."""


def unfold(trees: DataFrame, roots: DataFrame, keys: tuple[str, ...] = (), recursive: bool = True, strict: bool = True) -> DataFrame:
    """Entries below each root (``keys``, tree_id) with their ``parts`` (path components) and ``depth``.

    With ``strict`` a directory that holds itself raises CycleError; else it is not entered again. Shared
    subtrees are unfolded wherever they stand.
    """
    payload = [c for c in trees.columns if c not in ("tree_id", "name")]
    level = roots.select(*keys, "tree_id", F.array().cast("array<string>").alias("__at"), F.array("tree_id").alias("__up"))
    out, depth = None, 1
    while True:
        found = level.join(trees, "tree_id").select(*keys, F.concat("__at", F.array("name")).alias("parts"), F.lit(depth).alias("depth"), *payload, "__up")
        found = materialize(found, "unfold")
        rows = found.drop("__up")
        out = rows if out is None else out.unionByName(rows)
        deeper = found.where(F.col("subtree").isNotNull())
        looped = F.array_contains("__up", F.col("subtree"))
        if not recursive:
            return out
        if strict and not deeper.where(looped).isEmpty():
            raise CycleError("a directory holds itself")
        level = deeper.where(~looped).select(
            *keys, F.col("subtree").alias("tree_id"), F.col("parts").alias("__at"), F.concat("__up", F.array("subtree")).alias("__up"),
        )
        if level.isEmpty():
            return out
        depth += 1


def reachable_trees(trees: DataFrame, roots: DataFrame) -> DataFrame:
    """Distinct ids of the trees that roots (tree_id) reach, roots included. A round takes the trees not met before, so
    rounds and rows follow the distinct trees, however many roots or paths lead to them."""
    edges = materialize(trees.where("subtree is not null").select("tree_id", "subtree").distinct(), "tree-edges")
    front = materialize(roots.select("tree_id").distinct(), "tree-front")
    seen = front
    while not front.isEmpty():
        below = front.join(edges, "tree_id").select(F.col("subtree").alias("tree_id")).distinct()
        front = materialize(below.join(seen, "tree_id", "left_anti"), "tree-front")
        seen = seen.unionByName(front)
    return seen


def visits(trees: DataFrame, roots: DataFrame) -> DataFrame:
    """How often each tree stands below roots (tree_id, visits: how many roots it is), roots included: (tree_id, visits).

    A round adds the counts of all paths of one length, so its rows are distinct trees and not paths."""
    edges = trees.where("subtree is not null").groupBy("tree_id", "subtree").agg(F.count(F.lit(1)).alias("times"))
    edges = materialize(edges, "tree-edges")
    level = materialize(roots.groupBy("tree_id").agg(F.sum("visits").cast("long").alias("visits")), "tree-visits")
    out, depth, most = level, 0, None
    while not level.isEmpty():
        if depth >= 64:  # deep or endless: no path without a cycle is longer than there are trees
            most = trees.select("tree_id").distinct().count() if most is None else most
            if depth > most:
                raise CycleError("a directory holds itself")
        below = level.join(edges, "tree_id").groupBy(F.col("subtree").alias("tree_id")).agg(
            F.sum(F.col("visits") * F.col("times")).cast("long").alias("visits")
        )
        level = materialize(below, "tree-visits")
        out, depth = out.unionByName(level), depth + 1
    return out.groupBy("tree_id").agg(F.sum("visits").alias("visits"))


def holders(trees: DataFrame, lost: DataFrame) -> DataFrame:
    """Trees that reach lost blobs (blob_id) through their files' chunks or directories: (blob_id, tree_id), and each lost
    blob itself, as it may be a tree. It climbs from the blobs, so it costs nothing where none is lost."""
    chunks = trees.where("kind = 'file'").select(F.explode("chunks").alias("blob_id"), "tree_id").join(lost, "blob_id", "left_semi")
    edges = materialize(trees.where("subtree is not null").select("tree_id", "subtree").distinct(), "tree-edges")
    front = materialize(chunks.unionByName(lost.select("blob_id", F.col("blob_id").alias("tree_id"))).distinct(), "holders")
    seen = front
    while not front.isEmpty():
        above = front.withColumnRenamed("tree_id", "subtree").join(edges, "subtree").select("blob_id", "tree_id").distinct()
        front = materialize(above.join(seen, ["blob_id", "tree_id"], "left_anti"), "holders")
        seen = seen.unionByName(front)
    return seen


def cycles(edges: DataFrame, parent: str = "parent", child: str = "child") -> DataFrame:
    """Edges that close a cycle: those left when nodes without children, then their edges, are taken away until
    none goes, and likewise nodes without parents."""
    left = edges.select(F.col(parent).alias("parent"), F.col(child).alias("child")).distinct()
    size = None
    while True:
        left = materialize(left.join(left.select(F.col("parent").alias("child")).distinct(), "child", "left_semi"), "cycles")
        left = materialize(left.join(left.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi"), "cycles")
        n = left.count()
        if n in (0, size):
            return left.select("parent", "child")
        size = n


def listing(trees: DataFrame, tree_id: str) -> DataFrame:
    """One directory: names with ``/`` for directories and ``-> target`` for links, in order of name."""
    text = F.when(F.col("kind") == "directory", F.concat("name", F.lit("/"))).when(
        F.col("kind") == "symlink", F.concat("name", F.lit("-> "), "target"),
    ).otherwise(F.col("name"))
    return trees.where(F.col("tree_id") == tree_id).select("name", text.alias("line")).orderBy("name")


def listing_lines(entries: DataFrame) -> DataFrame:
    """Lines of a full listing: a directory before what it holds, by component."""
    path = F.array_join("parts", "/")
    text = F.when(F.col("kind") == "directory", F.concat(path, F.lit("/"))).when(
        F.col("kind") == "symlink", F.concat(path, F.lit(" -> "), F.col("target")),
    ).otherwise(path)
    return entries.select("parts", text.alias("line")).orderBy("parts")


class PathError(ValueError):
    """A path that can't be followed in a tree."""


def descend(trees: DataFrame, root: str, path: str) -> dict | None:
    """The entry at a path (None for the root itself)."""
    steps = [p for p in path.split("/") if p not in ("", ".")]
    if path.startswith("/") or ".." in steps:
        raise PathError(f"{path}: give a path inside the snapshot")
    at, row = root, None
    for i, step in enumerate(steps):
        hits = trees.where((F.col("tree_id") == at) & (F.col("name") == step)).take(1)
        if not hits:
            raise PathError(f"{'/'.join(steps[: i + 1])} is not in the snapshot")
        row = hits[0].asDict(recursive=True)
        if i < len(steps) - 1 and row["kind"] != "directory":
            raise PathError(f"{'/'.join(steps[: i + 1])} is no directory")
        at = row["subtree"]
    return row


def roll_up(nodes: DataFrame, leaf: Column, combine: Callable[[Column], Column], parent: str = "parent", child: str = "child") -> DataFrame:
    """Merkle digests of a hierarchy (parent, child, depth; the root has depth 0), bottom up.

    ``leaf`` gives a childless node's digest; ``combine`` makes a parent's of the sorted array of
    ``child=digest`` texts. Returns (node, depth, digest)."""
    depth = nodes.agg(F.max("depth")).first()[0]
    if depth is None:
        return nodes.select(F.col(child).alias("node"), "depth", F.lit(None).cast("string").alias("digest"))
    out, below = None, None
    for d in range(depth, -1, -1):
        here = nodes.where(F.col("depth") == d)
        if below is None:
            done = here.select(F.col(child).alias("node"), F.col(parent).alias("up"), "depth", leaf.alias("digest"))
        else:
            pairs = below.where("up is not null").groupBy(F.col("up").alias("node")).agg(
                combine(F.array_sort(F.collect_list(F.concat_ws("=", "node", "digest")))).alias("__own")
            )
            joined = here.select(F.col(child).alias("node"), F.col(parent).alias("up"), "depth", leaf.alias("__leaf")).join(pairs, "node", "left")
            done = joined.select("node", "up", "depth", F.coalesce("__own", "__leaf").alias("digest"))
        below = materialize(done, "roll-up")
        out = below if out is None else out.unionByName(below)
    return out.select("node", "depth", "digest")


def _hash_directory(table: pa.Table) -> pa.Table:
    rows = table.select(["name", "kind", "chunks", "subtree", "target", "meta"]).to_pylist()
    data = tree_bytes([r for r in rows if r["name"] is not None])
    first = table.slice(0, 1)
    return pa.table(
        {"snapshot_key": first.column("snapshot_key"), "dir": first.column("dir"), "tree_id": pa.array([object_id(data)]), "bytes": pa.array([data], pa.binary())}
    )


def build_trees(entries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Trees of flat entries (snapshot_key, parts, kind, chunks, target, meta), with exact ids.

    Returns tree rows in the form of ``TREE``, the trees as blobs (blob_id, length, bytes), and the roots
    (snapshot_key, tree_id). Directories are hashed bottom up, one round per level; an empty directory has the
    empty tree.
    """
    key = entries.schema["snapshot_key"].dataType.simpleString()
    flat = materialize(
        entries.select("snapshot_key", "parts", F.size("parts").alias("depth"), "kind", "chunks", F.lit(None).cast("string").alias("subtree"), "target", "meta"),
        "entries",
    )
    top = flat.agg(F.max("depth")).first()[0] or 0
    rows, blobs, ids = None, None, None
    for d in range(top, -1, -1):
        here = flat.where(F.col("depth") == d + 1)
        if ids is not None:
            known = ids.select("snapshot_key", F.col("dir").alias("parts"), F.col("tree_id").alias("__id"))
            here = here.join(known, ["snapshot_key", "parts"], "left").withColumn("subtree", F.when(F.col("kind") == "directory", F.col("__id"))).drop("__id")
        children = here.select(
            "snapshot_key", F.slice("parts", 1, F.lit(d)).alias("dir"), F.element_at("parts", -1).alias("name"), "kind", "chunks", "subtree", "target", "meta",
        )
        # Every directory of this depth has a row of its own, so that empty ones are hashed too.
        dirs = flat.where((F.col("depth") == d) & (F.col("kind") == "directory")).select("snapshot_key", F.col("parts").alias("dir")) if d else flat.select("snapshot_key").distinct().withColumn(
            "dir", F.array().cast("array<string>"),
        )
        children = materialize(children.unionByName(dirs, allowMissingColumns=True), "children")
        ids = materialize(
            children.groupBy("snapshot_key", "dir").applyInArrow(_hash_directory, f"snapshot_key {key}, dir array<string>, tree_id string, bytes binary"),
            "tree-ids",
        )
        named = children.where("name is not null").join(ids.select("snapshot_key", "dir", "tree_id"), ["snapshot_key", "dir"])
        level = named.select("tree_id", "name", "kind", "chunks", "subtree", "target", "meta")
        own = ids.select(F.col("tree_id").alias("blob_id"), F.octet_length("bytes").cast("long").alias("length"), "bytes")
        blobs = own if blobs is None else blobs.unionByName(own)
        rows = level if rows is None else rows.unionByName(level)
    return rows.dropDuplicates(["tree_id", "name"]), blobs.dropDuplicates(["blob_id"]), ids.select("snapshot_key", "tree_id")
