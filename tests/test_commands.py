"""The commands end to end, on small file trees (scenarios of diff, prune, copy, filter, restore, resume)."""

import io
import itertools
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from siltstone.operators import chunking, packs, restore, snapshots, trees, verify
from siltstone.plans import commands
from siltstone.sources import filesystem, objects, repository
from siltstone.sources.repository import Repository, RepositoryError


@pytest.fixture
def work(tmp_path):
    src = tmp_path / "src"
    (src / "views").mkdir(parents=True)
    (src / "archive").mkdir()
    for name, text in {"ledger.txt": "ledger", "map.txt": "map", "draft.txt": "draft", "list.txt": "list", "views/left.txt": "left", "views/right.txt": "right", "archive/fresh.bin": "fresh", "archive/cold.bin": "cold"}.items():
        (src / name).write_text(text * 50)
    for top, dirs, files in os.walk(src):  # so that reading does not touch access times (relatime)
        for name in [top, *[os.path.join(top, f) for f in files]]:
            at = os.lstat(name).st_mtime_ns
            os.utime(name, ns=(at + 10**9, at))
    return tmp_path


@pytest.fixture
def repo(spark, work):
    return commands.init(spark, str(work / "repo"))


def lines(df):
    return [r[-1] for r in df.collect()]


def no_access(rows):
    return [x for x in rows if not x.startswith("A ")]


def test_backup_diff_and_listing(repo, work):
    src = work / "src"
    first = commands.backup(repo, [str(src)])
    assert first["snapshot"] and first["files"] == 8
    assert no_access(lines(commands.diff_filesystem(repo, "LAST", metadata=True))) == []
    assert lines(commands.ls(repo, "LAST")) == ["src/", "src/archive/", "src/archive/cold.bin", "src/archive/fresh.bin", "src/draft.txt", "src/ledger.txt", "src/list.txt", "src/map.txt", "src/views/", "src/views/left.txt", "src/views/right.txt"]
    (src / "draft.txt").unlink()
    (src / "added.txt").write_text("")
    (src / "archive").rename(src / "yard")
    (src / "ledger.txt").write_text("other contents")
    (src / "map.txt").chmod(0o777)
    assert no_access(lines(commands.diff_filesystem(repo, "LAST", metadata=True))) == [
        "+ src/added.txt", "- src/archive/", "- src/archive/cold.bin", "- src/archive/fresh.bin", "- src/draft.txt", "C src/ledger.txt", "P src/map.txt",
        "+ src/yard/", "+ src/yard/cold.bin", "+ src/yard/fresh.bin", "T src/",
    ]
    second = commands.backup(repo, [str(src)])
    assert second["chunk_bytes"] == len("other contents")
    assert commands.check(repo, read_packs=True)["ok"]
    assert "C src/ledger.txt" in lines(commands.diff_snapshots(repo, "LAST~", "LAST"))
    (src / "list.txt").unlink()
    (src / "list.txt").symlink_to("elsewhere")
    assert no_access(lines(commands.diff_filesystem(repo, "LAST", metadata=True))) == ["- src/list.txt", "+ src/list.txt -> elsewhere", "T src/"]
    commands.backup(repo, [str(src)])
    (src / "list.txt").unlink()
    (src / "list.txt").symlink_to("nowhere")
    assert no_access(lines(commands.diff_filesystem(repo, "LAST", metadata=True))) == ["- src/list.txt -> elsewhere", "+ src/list.txt -> nowhere", "T src/"]
    # sizes: introduced and reused make up tree and chunk bytes
    rows = commands.snapshot_sizes(repo).collect()
    assert len(rows) == 3
    assert all(r["introduced"] + r["reused"] == r["tree_bytes"] + r["chunk_bytes"] for r in rows)
    use = commands.usage(repo).first()
    assert use["snapshots"] == 3 and use["unused_bytes"] == 0 and use["unique_bytes"] == sum(r["introduced"] for r in rows)
    stat = commands.snapshot_stat(repo)
    assert stat.where("code = 'C'").count() == 1


def test_repeats_and_forget(repo, work):
    src = str(work / "src")
    one = commands.backup(repo, [src])
    assert commands.backup(repo, [src])["snapshot"] is None
    again = commands.backup(repo, [src], allow_repeat=True)
    assert again["snapshot"] and again["tree"] == one["tree"] and again["chunk_bytes"] == 0
    assert commands.forget(repo, ["DUPLICATES"], dry_run=True) == [again["snapshot"]]
    commands.forget(repo, ["DUPLICATES"])
    assert repo.snapshots().count() == 1
    with pytest.raises(snapshots.SelectorError):
        commands.forget(repo, ["LAST~5"])
    assert commands.forget(repo, [one["snapshot"][:8]]) == [one["snapshot"]]
    empty = work / "empty"
    empty.mkdir()
    assert commands.backup(repo, [str(empty)])["snapshot"]  # a root that is an empty directory is an entry


def test_prune(repo, work):
    src = work / "src"
    commands.backup(repo, [str(src)])
    (src / "ledger.txt").write_text("changed")
    commands.backup(repo, [str(src)])
    assert commands.prune(repo)["rewrite"] == 0
    commands.forget(repo, ["LAST~"])
    plan = commands.prune(repo, dry_run=True)
    assert plan == {"keep": 2, "rewrite": 2, "drop": 0, "replace": 2}
    before = sorted(lines(commands.ls(repo, "LAST")))
    assert commands.prune(repo) == plan
    assert commands.check(repo, read_packs=True)["ok"]
    assert sorted(lines(commands.ls(repo, "LAST"))) == before
    assert commands.prune(repo) == {"keep": 4, "rewrite": 0, "drop": 0, "replace": 0}


def test_drop_only_prune_and_rebuild(repo, work):
    commands.backup(repo, [str(work / "src" / "views")])
    commands.backup(repo, [str(work / "src" / "archive")])
    commands.forget(repo, ["LAST~"])
    assert commands.prune(repo) == {"keep": 2, "rewrite": 0, "drop": 2, "replace": 2}
    assert len(repo.index_names()) == 1
    name = commands.rebuild_index(repo)
    assert repo.index_names() == [name] and commands.check(repo)["ok"]


def test_check_finds_losses(spark, repo, work):
    commands.backup(repo, [str(work / "src")])
    lost = repo.pack_names().where("kind = 'chunk'").first()
    shutil.rmtree(work / "repo" / "packs" / "kind=chunk" / f"bucket={lost['pack_id'][:2]}" / f"pack_id={lost['pack_id']}")
    found = commands.check(repo)
    assert not found["ok"] and found["missing_packs"].count() == 1


def test_copy_and_filter(spark, repo, work):
    src = work / "src"
    commands.backup(repo, [str(src)], author="me", tags=["x"])
    other = commands.init(spark, str(work / "other"))
    assert commands.copy(repo, other, dry_run=True).count() > 8
    assert other.snapshots().count() == 0
    commands.copy(repo, other)
    assert lines(commands.ls(other, "LAST")) == lines(commands.ls(repo, "LAST"))
    assert other.snapshots().first()["snapshot_id"] == repo.snapshots().first()["snapshot_id"]
    assert commands.copy(repo, other).count() == 0 and other.snapshots().count() == 1
    third = commands.init(spark, str(work / "third"))
    commands.copy(repo, third, skips=["src/archive"])
    assert not any("archive" in x for x in lines(commands.ls(third, "LAST")))
    assert commands.check(third, read_packs=True)["ok"]
    assert commands.filter_snapshot(repo, "LAST", ["nothing like it"]) is None
    made = commands.filter_snapshot(repo, "LAST", ["views$"], keep_metadata=True)
    assert not any("views/" in x for x in lines(commands.ls(repo, made)))
    with pytest.raises(ValueError):
        commands.filter_snapshot(repo, "LAST", ["views"], keep_metadata=True, author="you")


def test_dump_and_cat(repo, work):
    made = commands.backup(repo, [str(work / "src")])
    assert lines(commands.dump(repo, "LAST")) == ["src/"]
    assert lines(commands.dump(repo, "LAST", "src/views")) == ["left.txt", "right.txt"]
    assert bytes(commands.dump(repo, "LAST", "src/ledger.txt").first()[0]) == b"ledger" * 50
    for path, words in (("src/nope", "not in"), ("src/ledger.txt/x", "no directory"), ("../src", "inside")):
        with pytest.raises(ValueError, match=words):
            commands.dump(repo, "LAST", path)
    assert made["tree"] in commands.cat(repo, "snapshot", "LAST").first()[0]
    assert commands.cat(repo, "index", repo.index_names()[0]).count() == repo.manifest().count()
    pack = repo.pack_names().first()["pack_id"]
    assert commands.cat(repo, "pack", pack).count() > 0
    assert commands.cat(repo, "blob", made["tree"]).count() == 1


def test_restore(repo, work):
    src = work / "src"
    (src / "link").symlink_to("ledger.txt")
    commands.backup(repo, [str(src)])
    out = work / "out"
    dry = commands.restore_snapshot(repo, "LAST", str(out), dry_run=True)
    assert dry.count() == 12 and not out.exists()
    commands.restore_snapshot(repo, "LAST", str(out), times=True, permissions=True)
    for top, dirs, files in os.walk(src):
        for f in files:
            there = out / os.path.relpath(os.path.join(top, f), src)
            assert os.readlink(there) == os.readlink(os.path.join(top, f)) if there.is_symlink() else there.read_bytes() == open(os.path.join(top, f), "rb").read()
            assert there.lstat().st_mtime_ns == os.lstat(os.path.join(top, f)).st_mtime_ns
    assert commands.restore_snapshot(repo, "LAST", str(out)).count() == 0
    (src / "extra").write_text("x")
    (src / "ledger.txt").write_text("y")
    shutil.rmtree(src / "views")
    (src / "views").write_text("a file now")
    kept = {(tuple(r["parts"]), r["code"]) for r in commands.restore_snapshot(repo, "LAST").collect()}
    assert (("src", "ledger.txt"), "C") in kept and (("src", "extra"), "-") not in kept
    assert (src / "extra").exists() and (src / "views" / "left.txt").exists()
    commands.restore_snapshot(repo, "LAST", delete=True)
    assert not (src / "extra").exists()


def test_skips_and_errors(repo, work, spark):
    commands.backup(repo, [str(work / "src")], skips=["archive", r"left\.txt$"])
    assert not any("archive" in x or x.endswith("left.txt") for x in lines(commands.ls(repo, "LAST")))
    os.makedirs(work / "b" / "src")
    with pytest.raises(RepositoryError, match="last component"):
        commands.backup(repo, [str(work / "src"), str(work / "b" / "src")])
    with pytest.raises(RepositoryError, match="not empty"):
        commands.init(spark, str(work / "repo"))
    bad = os.fsencode(work / "src") + b"/fo\x80o"
    with open(bad, "w"):
        pass
    there = repo.pack_names().count()
    with pytest.raises(Exception, match="UTF-8"):
        commands.backup(repo, [str(work / "src")])
    assert repo.pack_names().count() == there


def test_resume_skips_what_is_stored(repo, work):
    src = str(work / "src")
    commands.backup(repo, [src])
    shutil.rmtree(work / "repo" / "snapshots")  # as if interrupted before the commit
    shutil.rmtree(work / "repo" / "indexes")
    assert commands.check(repo)["unindexed_packs"].count() == 2
    assert commands.resume(repo).count() == 2 and commands.resume(repo).count() == 0
    again = commands.backup(repo, [src])
    assert again["snapshot"] and again["chunk_bytes"] == 0 and again["tree_bytes"] == 0


def test_object_listing(spark, repo, work):
    commands.backup(repo, [str(work / "src")])
    totals = {r["prefix"]: r["objects"] for r in objects.totals_by_prefix(repo.objects()).collect()}
    assert {"packs", "indexes", "snapshots", "trees"} <= set(totals)
    entries = filesystem.scan(spark, [str(work / "src")])
    assert filesystem.totals(entries).first()["files"] == 8
    assert entries.where(F.col("kind") == "directory").count() == 3
    assert isinstance(repo, Repository)


def test_files_beyond_the_read_window():
    """Windows don't show in the chunks, and a file is never held whole."""
    data = random.Random(1).randbytes(3_000_000)
    want = chunking.cuts(data, 1 << 10, 1 << 12, 1 << 15)
    for window in (1, 50_000, 1 << 20, 1 << 24):
        found = list(filesystem.chunks_of(io.BytesIO(data), 1 << 10, 1 << 12, 1 << 15, window))
        assert b"".join(p for parts in found for p in parts) == data
        assert list(itertools.accumulate(len(p) for parts in found for p in parts)) == want
    assert list(filesystem.chunks_of(io.BytesIO(b""), 1, 2, 3)) == []


def test_restore_writes_pieces_in_any_order(tmp_path):
    place = str(tmp_path / "deep" / "file")
    restore.create([{"place": place, "kind": "file", "target": None}])
    for offset in (6, 0, 3):
        restore.write_pieces([{"place": place, "offset": offset, "bytes": b"abcdefgh"[offset : offset + 3]}])
    assert not os.path.exists(place)
    restore.finish([{"path": place}, {"path": place}])
    assert open(place, "rb").read() == b"abcdefgh"


def test_reach_follows_distinct_trees(spark):
    """Rows and rounds don't grow with equal snapshots or with paths: a chain of shared directories has 2 ** 12 paths."""
    depth = 12
    rows = [(f"t{i}", f"{side}", "directory", None, f"t{i + 1}") for i in range(depth) for side in "ab"] + [(f"t{depth}", "f", "file", ["c1", "c2", "c1"], None)]
    forest = spark.createDataFrame(rows, "tree_id string, name string, kind string, chunks array<string>, subtree string")
    roots = spark.createDataFrame([("t0",)] * 50 + [("t11",)], "tree_id string")
    assert {r[0] for r in trees.reachable_trees(forest, roots).collect()} == {f"t{i}" for i in range(depth + 1)}
    met = {r[0]: r[1] for r in trees.visits(forest, roots.withColumn("visits", F.lit(1).cast("long"))).collect()}
    assert met == {f"t{i}": 50 * 2**i + (i >= 11) * 2 ** (i - 11) for i in range(depth + 1)}
    lost = spark.createDataFrame([("c2",), ("t11",)], "blob_id string")
    assert {(r[0], r[1]) for r in trees.holders(forest, lost).collect()} == {("c2", f"t{i}") for i in range(13)} | {("t11", f"t{i}") for i in range(12)} | {("c2", "c2")}


def test_check_finds_planted_damage(spark, repo, work):
    """Wrong names of snapshots, indexes and packs, tree rows that differ from their blobs, broken trees."""
    commands.backup(repo, [str(work / "src")])
    every, manifest, entries = repo.snapshots(), repo.manifest(), repo.entries()
    assert verify.wrong_snapshots(every).count() == verify.wrong_packs(manifest).count() == verify.wrong_indexes(entries, repo.supersedes()).count() == 0
    assert verify.wrong_snapshots(every.withColumn("author", F.lit("someone"))).count() == 1
    one = manifest.first()["blob_id"]
    assert verify.wrong_packs(manifest.withColumn("length", F.when(F.col("blob_id") == one, 1).otherwise(F.col("length")))).count() == 1
    assert verify.wrong_indexes(entries.where(F.col("pack_id") != entries.first()["pack_id"]), repo.supersedes()).count() == 1
    rows, blobs = repo.trees(), repo.blobs().where("kind = 'tree'").select("blob_id", "bytes")
    assert verify.wrong_trees(blobs, rows).count() == 0
    assert [r["name"] for r in verify.wrong_trees(blobs, rows.where("name <> 'map.txt'")).collect()] == ["map.txt"]
    changed = rows.withColumn("kind", F.when(F.col("name") == "list.txt", "symlink").otherwise(F.col("kind")))
    assert {r["name"] for r in verify.wrong_trees(blobs, changed).collect()} == {"list.txt"}
    cut = blobs.withColumn("bytes", F.expr("substring(bytes, 1, length(bytes) - 3)"))
    assert None in {r["name"] for r in verify.wrong_trees(cut, rows).collect()}
    found = commands.check(repo, read_packs=True)
    assert found["ok"] and {"bad_snapshots", "bad_indexes", "bad_packs", "bad_trees"} <= set(found)


def test_filtered_repository(spark, work):
    """Blobs are stored as a command made them, and read through its inverse."""
    with pytest.raises(RepositoryError, match="both"):
        commands.init(spark, str(work / "x"), filter="cat")
    with pytest.raises(RepositoryError, match="inverse"):
        commands.init(spark, str(work / "x"), filter="tr a-z A-Z", unfilter="cat")
    repo = commands.init(spark, str(work / "x"), filter="gzip -c", unfilter="gzip -dc")
    commands.backup(repo, [str(work / "src")])
    assert all(bytes(r["bytes"])[:2] == b"\x1f\x8b" for r in repo.blobs().collect())
    assert bytes(commands.dump(repo, "LAST", "src/map.txt").first()[0]) == b"map" * 50
    assert commands.check(repo, read_packs=True)["ok"]


def test_many_packs_need_no_list_on_the_driver(spark):
    """Ten thousand packs are named by bucket, and their plan is one of columns."""
    manifest = spark.range(10_000).select(F.sha2(F.col("id").cast("string"), 224).alias("pack_id"), F.lit("chunk").alias("blob_type"), F.col("id").alias("blob_id"), F.lit(5).alias("length"))
    name = repository.index_name(manifest, ["b", "a"])
    assert name == repository.index_name(manifest.repartition(7), ["a", "b"]) != repository.index_name(manifest.where("blob_id > 0"), ["a", "b"])
    plan = packs.prune_plan(manifest, manifest.where("blob_id % 4 > 0").select("blob_id"), "pack_id", "blob_id", "length")
    assert {r["action"]: r["count"] for r in plan.groupBy("action").count().collect()} == {"keep": 7500, "drop": 2500}
