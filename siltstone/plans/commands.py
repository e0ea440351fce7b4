"""The commands, as functions over a repository. With ``dry_run`` nothing is written or deleted."""

from __future__ import annotations

import os
import time as clock
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.cbor import EMPTY_TREE
from ..functions.sizes import human_size
from ..operators import dedup, diff, filters, packs, restore, snapshots, trees, verify
from ..scratch import materialize
from ..sources import filesystem, objects
from ..sources.repository import PACK_SIZE, Repository, RepositoryError


def init(spark: SparkSession, root: str, pack_size: int = PACK_SIZE, filter: str | None = None, unfilter: str | None = None) -> Repository:
    return Repository(spark, root).init(pack_size, filter, unfilter)


def _flat(repo: Repository, chosen: DataFrame) -> DataFrame:
    """Entries of snapshots: snapshot_id, parts, path, kind, chunks, subtree, target, meta."""
    rows = trees.unfold(repo.trees(), chosen.where(F.col("tree_id") != EMPTY_TREE).select("snapshot_id", "tree_id"), ("snapshot_id",))
    return rows.withColumn("path", F.array_join("parts", "/"))


def _references(repo: Repository, chosen: DataFrame) -> DataFrame:
    """Every visit of a blob by a snapshot: snapshot_id, time_ns, parts, seq, blob_id, kind, length."""
    times = chosen.select("snapshot_id", "time_ns")
    flat = _flat(repo, chosen)
    roots = chosen.where(F.col("tree_id") != EMPTY_TREE).select(
        "snapshot_id", F.array().cast("array<string>").alias("parts"), F.lit(-1).alias("seq"), F.col("tree_id").alias("blob_id"), F.lit("tree").alias("kind"),
    )
    below = flat.where((F.col("kind") == "directory") & (F.col("subtree") != EMPTY_TREE)).select(
        "snapshot_id", "parts", F.lit(-1).alias("seq"), F.col("subtree").alias("blob_id"), F.lit("tree").alias("kind"),
    )
    chunk = flat.where("kind = 'file'").select("snapshot_id", "parts", F.posexplode("chunks").alias("seq", "blob_id"), F.lit("chunk").alias("kind"))
    refs = roots.unionByName(below).unionByName(chunk)
    lengths = dedup.blob_map(repo.manifest(), "length").select("blob_id", "length")
    return refs.join(times, "snapshot_id").join(lengths, "blob_id", "left")


def _reached(repo: Repository, chosen: DataFrame) -> DataFrame:
    """Distinct blobs that snapshots reach (blob_id, kind), by distinct trees."""
    own = materialize(repo.trees(), "trees")
    below = trees.reachable_trees(own, chosen.where(F.col("tree_id") != EMPTY_TREE)).where(F.col("tree_id") != EMPTY_TREE)
    chunks = own.where("kind = 'file'").join(below, "tree_id", "left_semi").select(F.explode("chunks").alias("blob_id")).distinct()
    return chunks.withColumn("kind", F.lit("chunk")).unionByName(below.select(F.col("tree_id").alias("blob_id"), F.lit("tree").alias("kind")))


def _visited(repo: Repository, chosen: DataFrame) -> DataFrame:
    """Blobs and how often all snapshots visit them: blob_id, kind, visits."""
    own = materialize(repo.trees(), "trees")
    roots = chosen.where(F.col("tree_id") != EMPTY_TREE).groupBy("tree_id").agg(F.count(F.lit(1)).alias("visits"))
    met = materialize(trees.visits(own, roots).where(F.col("tree_id") != EMPTY_TREE), "visits")
    chunks = own.where("kind = 'file'").join(met, "tree_id").select(F.explode("chunks").alias("blob_id"), "visits").groupBy("blob_id").agg(
        F.sum("visits").alias("visits")
    )
    return chunks.select("blob_id", F.lit("chunk").alias("kind"), "visits").unionByName(
        met.select(F.col("tree_id").alias("blob_id"), F.lit("tree").alias("kind"), "visits")
    )


def visited(repo: Repository) -> DataFrame:
    """Blobs and how often all snapshots of a repository visit them: blob_id, kind, visits."""
    return _visited(repo, repo.snapshots())


def snapshot_root(repo: Repository, selector: str) -> str:
    """The tree of a snapshot."""
    return snapshots.select(repo.snapshots(), selector).first()["tree_id"]


def decoded_trees(repo: Repository) -> DataFrame:
    """Entries of all indexed trees, decoded from their blobs."""
    named = repo.manifest().where("blob_type = 'tree'").select("pack_id", "blob_id")
    blobs = repo.blobs().where("kind = 'tree'").join(named, ["pack_id", "blob_id"], "left_semi").select("blob_id", "bytes")
    return verify.decode_trees(repo.contents(blobs))


def _missing_chunks(repo: Repository, chosen: DataFrame, manifest: DataFrame) -> DataFrame:
    """Blobs that snapshots reach and no pack holds: chunk, snapshots (how many reach it), first_snapshot."""
    lost = materialize(packs.missing(_reached(repo, chosen), manifest, "blob_id"), "lost")
    held = trees.holders(repo.trees(), lost).join(chosen.select("tree_id", "snapshot_id"), "tree_id").select(
        F.col("blob_id").alias("chunk"), "snapshot_id",
    ).distinct()
    return held.groupBy("chunk").agg(F.count(F.lit(1)).alias("snapshots"), F.min("snapshot_id").alias("first_snapshot"))


def backup(
    repo: Repository,
    roots: list[str],
    skips: Iterable[str] = (),
    author: str = "",
    tags: Iterable[str] = (),
    follow: bool = False,
    allow_empty: bool = False,
    allow_repeat: bool = False,
    dry_run: bool = False,
    force_hash: bool = False,
    time_ns: int | None = None,
    chunker: tuple[int, int, int] | None = None,
) -> dict:
    """Back up file trees. Returns what was done: snapshot (None if none was made), tree, counts of files and bytes
    (read, in new chunks and trees, reused, and as stored after compression), packs and indexes written."""
    spark = repo.spark
    roots = sorted({os.path.realpath(r) if follow else os.path.abspath(r) for r in roots})
    if missing := [r for r in roots if not os.path.lexists(r)]:
        raise RepositoryError(f"not there: {', '.join(missing)}")
    if not snapshots.clashing_roots(spark.createDataFrame([(r,) for r in roots], "path string")).isEmpty():
        raise RepositoryError("roots may not share their last component")
    found = materialize(filesystem.scan(spark, roots, list(skips), follow), "walk")  # fails before anything is written
    totals = filesystem.totals(found).first()
    entries = filters.ordinary(found)
    past = repo.snapshots()
    before = _flat(repo, snapshots.parent(past, roots)).select(
        "path", "kind", F.col("meta.mtime_ns").alias("mtime_ns"), F.col("meta.size").alias("size"), "chunks",
    )
    marked = materialize(filters.with_previous(entries, before, force_hash=force_hash), "marked")
    cut = materialize(filesystem.chunk_files(marked.where("kind = 'file' and changed"), *(chunker or ())), "chunks")
    stored = repo.manifest().select("blob_id")
    fresh = dedup.new_blobs(cut, stored)
    lists = cut.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "blob_id"))), lambda x: x["blob_id"]).alias("new_chunks"))
    listed = marked.join(lists, "path", "left")
    chunks = F.when(F.col("kind") == "file", F.when(F.col("changed"), F.coalesce("new_chunks", F.array().cast("array<string>"))).otherwise(F.col("old_chunks")))
    flat = listed.select(F.lit(0).alias("snapshot_key"), "parts", "kind", chunks.alias("chunks"), "target", "meta")
    rows, blobs, top = trees.build_trees(flat)
    root_row = top.first()
    root = root_row["tree_id"] if root_row else EMPTY_TREE
    new_trees = dedup.new_blobs(blobs.where(F.col("blob_id") != EMPTY_TREE), stored)
    out = {"tree": root, "files": totals["files"], "bytes": totals["bytes"], "special": totals["special"], "snapshot": None}
    if dry_run:
        sums = fresh.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0], new_trees.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
        return out | {"chunk_bytes": sums[0], "tree_bytes": sums[1]}
    made = repo.write_packs(fresh, "chunk").unionByName(repo.write_packs(new_trees, "tree"))
    repo.write_trees(rows, made)
    repo.write_index(made)
    new = materialize(made.select("pack_id", "blob_type", "length"), "new-packs")
    sums = {r["blob_type"]: r["n"] for r in new.groupBy("blob_type").agg(F.sum("length").alias("n")).collect()}
    named = new.select("pack_id").distinct()
    stored = repo.pack_sizes().join(named, "pack_id").agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    out |= {"chunk_bytes": sums.get("chunk", 0), "tree_bytes": sums.get("tree", 0)}
    out |= {"reused_bytes": out["bytes"] - out["chunk_bytes"], "packs": stored[0], "stored_bytes": stored[1], "indexes": int(stored[0] > 0)}
    if root == EMPTY_TREE and not allow_empty:
        return out
    last = snapshots.nth_from_last(past, 0).first()
    row = {"author": author, "tags": list(tags), "paths": roots, "tree_id": root}
    if last and not allow_repeat and snapshots.same_but_time(last.asDict(), row):
        return out
    return out | {"snapshot": repo.write_snapshot(clock.time_ns() if time_ns is None else time_ns, "UTC", author, tags, roots, root)}


def ls(repo: Repository, selector: str) -> DataFrame:
    return trees.listing_lines(_flat(repo, snapshots.select(repo.snapshots(), selector)))


def cat(repo: Repository, kind: str, name: str) -> DataFrame:
    """JSON of a snapshot, index, pack or tree; the bytes of a chunk."""
    if kind == "snapshot":
        return snapshots.select(repo.snapshots(), name).select(F.to_json(F.struct("*")).alias("json"))
    if kind == "index":
        return repo.entries().where(F.col("index_id") == name).orderBy("pack_id", "seq").select(
            F.to_json(F.struct("pack_id", "blob_type", "length", "blob_id")).alias("json")
        )
    if kind == "pack":
        return repo.blobs().where(F.col("pack_id") == name).orderBy("seq").select(
            F.to_json(F.struct(F.col("kind").alias("type"), "length", F.col("blob_id").alias("id"))).alias("json")
        )
    if kind != "blob":
        raise ValueError(f"no such kind: {kind}")
    held = repo.manifest().where(F.col("blob_id") == name).take(1)
    if not held:
        raise RepositoryError(f"no blob {name}")
    if held[0]["blob_type"] == "tree":
        return repo.trees().where(F.col("tree_id") == name).orderBy("name").select(F.to_json(F.struct("*")).alias("json"))
    return repo.contents(repo.blobs().where((F.col("kind") == "chunk") & (F.col("pack_id") == held[0]["pack_id"]) & (F.col("blob_id") == name)).select("bytes"))


def check(repo: Repository, read_packs: bool = False) -> dict[str, DataFrame | bool]:
    """What is wrong: missing packs and chunks (or corrupt blobs) fail; unindexed packs only warn."""
    manifest, there = materialize(repo.manifest(), "manifest"), repo.pack_names()
    chosen = repo.snapshots()
    out: dict[str, DataFrame | bool] = {
        "missing_packs": packs.missing(manifest, there, "pack_id"),
        "unindexed_packs": packs.missing(there, manifest, "pack_id"),
        "missing_chunks": _missing_chunks(repo, chosen, manifest),
        "duplicates": dedup.uniqueness_violations(manifest),
    }
    # Names are ids, so what was read must have them.
    out["bad_snapshots"] = verify.wrong_snapshots(chosen)
    out["bad_indexes"] = verify.wrong_indexes(repo.entries(), repo.supersedes())
    out["bad_packs"] = verify.wrong_packs(manifest)
    bad = [out[k] for k in ("missing_packs", "missing_chunks", "duplicates", "bad_snapshots", "bad_indexes", "bad_packs")]
    if read_packs:
        blobs = repo.blobs()
        read = repo.contents(blobs.select("pack_id", "blob_id", "kind", "bytes"))
        out["corrupt"] = verify.corrupt_blobs(read, "bytes", text_ids=True).select("pack_id", "blob_id", "actual_id")
        out["bad_trees"] = verify.wrong_trees(read.where("kind = 'tree'"), repo.trees())
        bad.append(out["bad_trees"])
        own = blobs.select("pack_id", "seq", F.col("kind").alias("blob_type"), "length", "blob_id")
        indexed = manifest.select("pack_id", "seq", "blob_type", "length", "blob_id")
        out["mismatched"] = verify.manifest_mismatches(own.join(indexed.select("pack_id").distinct(), "pack_id", "left_semi"), indexed)
        bad += [out["corrupt"], out["mismatched"]]
    out["ok"] = all(b.isEmpty() for b in bad)
    return out


def diff_snapshots(repo: Repository, a: str, b: str, metadata: bool = False) -> DataFrame:
    """Lines by which snapshot ``b`` differs from ``a``."""
    every = repo.snapshots()
    left, right = (_flat(repo, snapshots.select(every, x)) for x in (a, b))
    return diff.report(diff.compare(left, right, ["parts"], metadata))


def diff_filesystem(repo: Repository, selector: str, metadata: bool = False) -> DataFrame:
    """Lines by which the file system differs from a snapshot. Chunks of files with equal time and size
    count as equal; others are read."""
    chosen = snapshots.select(repo.snapshots(), selector)
    old = materialize(_flat(repo, chosen), "old")
    return diff.report(diff.compare(old, _scan_like(repo, chosen.first()["paths"], old), ["parts"], metadata))


def _scan_like(repo: Repository, roots: list[str], old: DataFrame) -> DataFrame:
    """The roots as entries with chunks, reading only files that changed against ``old``."""
    before = old.select("path", "kind", F.col("meta.mtime_ns").alias("mtime_ns"), F.col("meta.size").alias("size"), "chunks")
    roots = [r for r in roots if os.path.lexists(r)]
    if not roots:
        return old.limit(0).select("path", "parts", "kind", "chunks", "target", "meta")
    marked = materialize(filters.with_previous(filters.ordinary(filesystem.scan(repo.spark, roots)), before), "marked")
    cut = filesystem.chunk_files(marked.where("kind = 'file' and changed")).groupBy("path").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "blob_id"))), lambda x: x["blob_id"]).alias("new_chunks")
    )
    chunks = F.when(F.col("kind") == "file", F.when(F.col("changed"), F.coalesce("new_chunks", F.array().cast("array<string>"))).otherwise(F.col("old_chunks")))
    return marked.join(cut, "path", "left").select("path", "parts", "kind", chunks.alias("chunks"), "target", "meta")


def dump(repo: Repository, selector: str, path: str = "") -> DataFrame:
    """A directory's listing (line), or a file's content (content)."""
    chosen = snapshots.select(repo.snapshots(), selector).first()
    row = trees.descend(repo.trees(), chosen["tree_id"], path)
    if row is None or row["kind"] == "directory":
        return trees.listing(repo.trees(), row["subtree"] if row else chosen["tree_id"]).select("line")
    if row["kind"] == "symlink":
        return repo.spark.createDataFrame([(f"{path} -> {row['target']}",)], "line string")
    chunks = _chunks(repo, repo.spark.createDataFrame([(path, row["chunks"])], "path string, chunks array<string>"))
    return chunks.orderBy("seq").select(F.col("bytes").alias("content"))


def _chunks(repo: Repository, files: DataFrame) -> DataFrame:
    """(path, seq, offset, bytes) of the chunks of files (path, chunks); a file is never put together in one cell."""
    wanted = files.select("path", F.posexplode("chunks").alias("seq", "blob_id"))
    places = dedup.blob_map(repo.manifest().where("blob_type = 'chunk'"), "length").select("blob_id", "pack_id", "length")
    found = materialize(wanted.join(places, "blob_id", "left"), "places")
    lost = found.where("pack_id is null").take(1)
    if lost:
        raise RepositoryError(f"chunk {lost[0]['blob_id']} is missing")
    before = Window.partitionBy("path").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)  # ids and lengths of one file
    placed = found.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    held = repo.contents(
        repo.blobs().where("kind = 'chunk'").join(found.select("blob_id", "pack_id").distinct(), ["blob_id", "pack_id"], "left_semi").select("blob_id", "pack_id", "bytes")
    )
    return placed.join(held, ["blob_id", "pack_id"]).select("path", "seq", "offset", "bytes")


def _filtered(repo: Repository, chosen: DataFrame, skips: list[str]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Snapshots without what is skipped (by paths in the tree): (entries, tree rows, tree blobs, old and new roots)."""
    kept = materialize(filters.keep_unskipped(_flat(repo, chosen), skips), "kept")
    # A snapshot without entries has the empty tree.
    rows, blobs, roots = trees.build_trees(kept.select(F.col("snapshot_id").alias("snapshot_key"), "parts", "kind", "chunks", "target", "meta"))
    roots = chosen.select("snapshot_id", F.col("tree_id").alias("old_tree")).join(roots.withColumnRenamed("snapshot_key", "snapshot_id"), "snapshot_id", "left")
    return kept, rows, blobs, roots.select("snapshot_id", "old_tree", F.coalesce("tree_id", F.lit(EMPTY_TREE)).alias("tree_id"))


def filter_snapshot(
    repo: Repository,
    selector: str,
    skips: list[str],
    keep_metadata: bool = False,
    author: str | None = None,
    tags: Iterable[str] = (),
    dry_run: bool = False,
    time_ns: int | None = None,
) -> str | None:
    """A snapshot without what is skipped; None if that changes nothing."""
    if not skips:
        raise ValueError("give something to skip")
    if keep_metadata and (author is not None or list(tags)):
        raise ValueError("metadata is either kept or given")
    chosen = snapshots.select(repo.snapshots(), selector)
    old = chosen.first()
    kept, rows, blobs, roots = _filtered(repo, chosen, skips)
    held = repo.manifest().select("blob_id")
    files = kept.where("kind = 'file'").select(F.explode("chunks").alias("blob_id"))
    if not files.join(held, "blob_id", "left_anti").isEmpty():
        raise RepositoryError("chunks of kept files are missing")
    tree = roots.first()["tree_id"]
    if tree == old["tree_id"] or dry_run:
        return None
    made = repo.write_packs(dedup.new_blobs(blobs, held), "tree")
    repo.write_trees(rows, made)
    repo.write_index(made)
    if keep_metadata:
        return repo.write_snapshot(old["time_ns"], old["tz"], old["author"], old["tags"] or (), old["paths"], tree)
    return repo.write_snapshot(clock.time_ns() if time_ns is None else time_ns, "UTC", author or "", tags, old["paths"], tree)


def copy(repo: Repository, to: Repository, selectors: list[str] | None = None, skips: list[str] = (), dry_run: bool = False) -> DataFrame:
    """Copy snapshots (all by default) and what they need; returns the blobs copied (blob_id, blob_type, length)."""
    every = repo.snapshots()
    chosen = materialize(every if selectors is None else snapshots.select_all(every, selectors), "chosen")
    kept, rows, blobs, roots = _filtered(repo, chosen, list(skips))
    held = to.manifest().select("blob_id")
    chunks = kept.where("kind = 'file'").select(F.explode("chunks").alias("blob_id")).distinct().join(held, "blob_id", "left_anti")
    source = repo.contents(
        repo.blobs().where("kind = 'chunk'").join(chunks, "blob_id", "left_semi").dropDuplicates(["blob_id"]).select("blob_id", "length", "bytes")
    )
    new_trees = dedup.new_blobs(blobs, held)
    plan = materialize(
        source.select("blob_id", F.lit("chunk").alias("blob_type"), "length").unionByName(
            new_trees.select("blob_id", F.lit("tree").alias("blob_type"), "length")
        ),
        "copy",
    )
    if not dry_run:
        made = to.write_packs(source, "chunk").unionByName(to.write_packs(new_trees, "tree"))
        to.write_trees(rows, made)
        to.write_index(made)
        for r in chosen.join(roots.select("snapshot_id", F.col("tree_id").alias("new_tree")), "snapshot_id").orderBy("time_ns").collect():  # one row per snapshot
            to.write_snapshot(r["time_ns"], r["tz"], r["author"], r["tags"] or (), r["paths"], r["new_tree"])
    return plan


def forget(repo: Repository, selectors: list[str], dry_run: bool = False) -> list[str]:
    """Remove snapshots: those selected, or with the sole word DUPLICATES those that repeat the one before.

    Unknown selectors raise an error after the others are removed."""
    every = repo.snapshots()
    wrong: list[str] = []
    if selectors == ["DUPLICATES"]:
        gone = [r["snapshot_id"] for r in snapshots.repeats(every, "tree_id", [F.col("time_ns"), F.col("snapshot_id")]).select("snapshot_id").collect()]
    else:
        gone = []
        for text in selectors:
            try:
                gone.append(snapshots.select(every, text).first()["snapshot_id"])
            except snapshots.SelectorError as e:
                wrong.append(str(e))
    gone = list(dict.fromkeys(gone))
    if not dry_run:
        repo.remove_snapshots(gone)
    if wrong:
        raise snapshots.SelectorError("; ".join(wrong))
    return gone


def prune(repo: Repository, dry_run: bool = False) -> dict[str, int]:
    """Rewrite packs that hold dead blobs. Returns how many packs are kept, rewritten and dropped, and indexes replaced."""
    manifest = materialize(repo.manifest(), "manifest")
    live = materialize(_reached(repo, repo.snapshots()).select("blob_id"), "live")
    classes = materialize(packs.classify(manifest, live, "pack_id", "blob_id", "length"), "classes")
    found = {r["class"]: r["packs"] for r in packs.class_totals(classes).collect()}
    old = repo.index_names()
    out = {"keep": found.get("reusable", 0), "rewrite": found.get("sparse", 0), "drop": found.get("droppable", 0), "replace": len(old)}
    if not out["rewrite"] and not out["drop"]:
        return out | {"replace": 0}
    if dry_run:
        return out
    moved = packs.to_repack(manifest, live, classes, "pack_id", "blob_id")
    reusable = classes.where(F.col("class") == "reusable").select("pack_id")
    made = manifest.join(reusable, "pack_id", "left_semi")
    for kind in ("chunk", "tree"):
        blobs = repo.blobs().where(F.col("kind") == kind).join(moved, "blob_id", "left_semi").dropDuplicates(["blob_id"])
        own = repo.write_packs(blobs, kind, stored=True)
        if kind == "tree":
            repo.write_trees(materialize(repo.trees(), "trees"), own)
        made = made.unionByName(own)
    repo.write_index(materialize(made, "new-index"), old)
    gone = materialize(manifest.select("pack_id", F.col("blob_type").alias("kind")).distinct().join(reusable, "pack_id", "left_anti"), "gone")
    repo.remove_indexes(old)
    repo.remove_packs(gone)
    return out


def rebuild_index(repo: Repository, dry_run: bool = False) -> str | None:
    """A new index from the packs that are there, superseding all others."""
    manifest = repo.blobs().select("pack_id", "seq", F.col("kind").alias("blob_type"), "length", "blob_id")
    if manifest.isEmpty():
        raise RepositoryError("there are no packs")
    old = repo.index_names()
    if dry_run:
        return None
    name = repo.write_index(materialize(manifest, "manifest"), [o for o in old])
    repo.remove_indexes(o for o in old if o != name)
    return name


def resume(repo: Repository, dry_run: bool = False) -> DataFrame:
    """Take up what an interrupted run left: packs that are there, whole, and in no index get one, so that the next run
    finds their blobs stored. Packs that repeat an indexed blob are left to prune. Returns the packs taken up (pack_id)."""
    manifest, blobs = repo.manifest(), repo.blobs()
    left = packs.missing(repo.pack_names(), manifest, "pack_id")
    entries = blobs.join(left, "pack_id", "left_semi").select("pack_id", "seq", F.col("kind").alias("blob_type"), "length", "blob_id")
    half = packs.missing(entries.where("blob_type = 'tree'"), repo.tree_pack_names(), "pack_id")
    again = entries.join(manifest.select("blob_id"), "blob_id", "left_semi").select("pack_id")
    whole = materialize(entries.join(half.union(again).distinct(), "pack_id", "left_anti"), "resume")
    if not dry_run:
        repo.write_index(whole)
    return whole.select("pack_id").distinct()


def restore_snapshot(
    repo: Repository, selector: str, output: str | None = None, delete: bool = False, times: bool = False, permissions: bool = False, dry_run: bool = False,
) -> DataFrame:
    """Bring the file system to a snapshot; returns the actions (parts, code, kind, target, place).

    A snapshot of one root maps onto ``output``, one of several under it; without ``output`` each root goes to where it was."""
    chosen = snapshots.select(repo.snapshots(), selector)
    roots = chosen.first()["paths"]
    place = {os.path.basename(r): r if output is None else output if len(roots) == 1 else os.path.join(output, os.path.basename(r)) for r in roots}
    new = materialize(_flat(repo, chosen), "new")
    old = None
    for name, there in place.items():
        if os.path.lexists(there):
            part = _scan_like(repo, [there], new.limit(0)) if os.path.basename(there) != name else _scan_like(repo, [there], new)
            renamed = part.withColumn("parts", F.concat(F.array(F.lit(name)), F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 1, F.lit(0)))))
            old = renamed if old is None else old.unionByName(renamed)
    old = materialize(new.limit(0).select("path", "parts", "kind", "chunks", "target", "meta") if old is None else old, "old")
    actions = restore.plan(old, new, ["parts"], delete, times, permissions)
    target = F.lit(None).cast("string")
    for name, there in place.items():
        target = F.when(F.element_at("parts", 1) == name, F.lit(there)).otherwise(target)
    actions = materialize(actions.withColumn("place", restore.remap(F.col("parts"), target)), "restore")
    if not dry_run:
        _carry_out(repo, actions, new, times, permissions)
    return actions


def _carry_out(repo: Repository, actions: DataFrame, new: DataFrame, times: bool, permissions: bool) -> None:
    """Removals, then files in pieces, then metadata; each step runs on all executors."""
    full = actions.join(new.select("parts", "chunks"), "parts", "left")
    files = full.where("code in ('+', 'C') and kind = 'file'").select(F.col("place").alias("path"), "chunks")
    pieces = _chunks(repo, files).select(F.col("path").alias("place"), "offset", "bytes")
    actions.where("code = '-'").select("place", F.size("parts").alias("depth")).foreachPartition(restore.remove)
    full.where("code in ('+', 'C')").select("place", "kind", "target").foreachPartition(restore.create)
    pieces.foreachPartition(restore.write_pieces)
    files.select("path").foreachPartition(restore.finish)
    if times or permissions:
        wanted = new.select(F.col("parts").alias("__p"), F.col("kind").alias("__kind"), "meta")
        places = actions.where("code <> '-'").join(wanted, F.col("parts") == F.col("__p"))
        places = materialize(places.select("place", F.col("__kind").alias("kind"), F.size("parts").alias("depth"), "meta"), "metadata")
        settle = restore.setter(times, permissions)
        places.where("kind <> 'directory'").foreachPartition(settle)
        for r in places.where("kind = 'directory'").groupBy("depth").count().orderBy(F.desc("depth")).collect():  # children first
            places.where((F.col("kind") == "directory") & (F.col("depth") == r["depth"])).foreachPartition(settle)


def list_snapshots(repo: Repository, selectors: list[str] | None = None, reverse: bool = False) -> DataFrame:
    every = repo.snapshots()
    chosen = every if not selectors else snapshots.select_all(every, selectors)
    return chosen.orderBy(F.desc("time_ns"), F.desc("snapshot_id")) if reverse else snapshots.chronological(chosen)


def snapshot_sizes(repo: Repository, selectors: list[str] | None = None, by_file: bool = False) -> DataFrame:
    """Bytes that each snapshot (and file) introduced and reused, counted over all snapshots in order of time;
    the selection is made last."""
    every = repo.snapshots()
    refs = _references(repo, every)
    if by_file:
        refs = refs.where("kind = 'chunk'")
    keys = ["snapshot_id", "parts"] if by_file else ["snapshot_id"]
    order = [F.col("time_ns"), F.col("snapshot_id"), F.col("parts"), F.col("seq")]
    sizes = dedup.introduced(refs, "blob_id", "length", order, keys)
    if not by_file:
        kinds = refs.groupBy("snapshot_id").agg(
            F.coalesce(F.sum(F.when(F.col("kind") == "tree", F.col("length"))), F.lit(0)).alias("tree_bytes"),
            F.coalesce(F.sum(F.when(F.col("kind") == "chunk", F.col("length"))), F.lit(0)).alias("chunk_bytes"),
        )
        sizes = sizes.join(kinds, "snapshot_id")
    return sizes.join(snapshots.select_all(every, selectors).select("snapshot_id"), "snapshot_id", "left_semi") if selectors else sizes


def snapshot_stat(repo: Repository, selectors: list[str] | None = None, metadata: bool = False) -> DataFrame:
    """What each snapshot changed against the one before (snapshot_id, parts, code, kind, target)."""
    every = repo.snapshots()
    changes = diff.consecutive(every, _flat(repo, every), "snapshot_id", ["time_ns", "snapshot_id"], ["parts"], metadata)
    return changes.join(snapshots.select_all(every, selectors).select("snapshot_id"), "snapshot_id", "left_semi") if selectors else changes


def usage(repo: Repository) -> DataFrame:
    """One row: snapshots, first and last time, unique and reused bytes, packs, indexes, packed and unused bytes, stored bytes."""
    every, manifest = repo.snapshots(), repo.manifest()
    lengths = dedup.blob_map(manifest, "length").select("blob_id", "length")
    met = _visited(repo, every).groupBy("blob_id").agg(F.sum("visits").alias("visits")).join(lengths, "blob_id")
    unique, reused = F.sum("length"), F.sum((F.col("visits") - 1) * F.col("length"))
    sizes = met.agg(F.coalesce(unique, F.lit(0)).alias("unique_bytes"), F.coalesce(reused, F.lit(0)).alias("reused_bytes"))
    heads = every.agg(F.count(F.lit(1)).alias("snapshots"), F.min("time_ns").alias("first_ns"), F.max("time_ns").alias("last_ns"))
    packed = manifest.agg(F.count_distinct("pack_id").alias("packs"), F.coalesce(F.sum("length"), F.lit(0)).alias("packed_bytes"))
    stored = objects.totals_by_prefix(repo.objects()).agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("stored_bytes"))
    row = heads.crossJoin(sizes).crossJoin(packed).crossJoin(stored)  # one row each
    return row.withColumn("indexes", F.lit(len(repo.index_names()))).withColumn("unused_bytes", F.col("packed_bytes") - F.col("unique_bytes")).withColumn(
        "stored", human_size(F.col("stored_bytes")),
    )
