"""Operators on small hand-made tables."""

import os

import pytest
from pyspark.sql import functions as F

from siltstone import scratch
from siltstone.functions import cbor
from siltstone.operators import cache, dedup, diff, filters, packs, restore, snapshots, trees, windows
from siltstone.plans.queries import QUERIES
from siltstone.streaming import ingest


def test_introduced_counts_repeats_in_one_file(spark):
    rows = [(1, "a", 0, "x", 5), (1, "a", 1, "x", 5), (1, "b", 0, "y", 7), (2, "a", 0, "x", 5), (2, "c", 0, "z", 1)]
    refs = spark.createDataFrame(rows, "snap int, path string, seq int, blob string, n long")
    got = {r["snap"]: (r["introduced"], r["reused"]) for r in dedup.introduced(refs, "blob", "n", [F.col("snap"), F.col("path"), F.col("seq")], ["snap"]).collect()}
    assert got == {1: (12, 5), 2: (1, 5)}


def test_selectors(spark):
    names = [cbor.object_id(bytes([i])) for i in range(4)]
    frame = spark.createDataFrame([(n, i, "t", ["p"]) for i, n in enumerate(names)], "snapshot_id string, time_ns long, tree_id string, paths array<string>")
    pick = lambda s: snapshots.select(frame, s).first()["snapshot_id"]
    assert pick("LAST") == pick("HEAD") == names[3] and pick("LAST~") == names[2] and pick("HEAD~3") == names[0] and pick("LAST~0") == names[3]
    assert pick(names[1]) == names[1] and pick(names[1][:6]) == names[1]
    for bad in ("LAST~4", "last", "zzzzzz", "ab", cbor.object_id(b"?")):
        with pytest.raises(snapshots.SelectorError):
            snapshots.select(frame, bad)
    assert [r["snapshot_id"] for r in snapshots.select_all(frame, ["LAST", names[0], "HEAD"]).collect()] == [names[0], names[3]]
    assert snapshots.parent(frame, ["p"]).first()["snapshot_id"] == names[3] and snapshots.parent(frame, ["q"]).isEmpty()
    assert snapshots.repeats(frame, "tree_id", [F.col("time_ns")]).count() == 3


def test_a_b_a_is_no_repeat(spark):
    frame = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "a")], "time_ns long, tree string")
    assert [r["time_ns"] for r in snapshots.repeats(frame, "tree", [F.col("time_ns")]).collect()] == [4]


def test_pack_classes(spark):
    manifest = spark.createDataFrame([("p", "a", 1), ("p", "b", 2), ("q", "c", 4), ("r", "a", 8), ("r", "d", 16)], "pack string, blob string, n long")
    live = spark.createDataFrame([("a",), ("b",)], "blob string")
    got = {r["pack"]: (r["class"], r["bytes"], r["live_bytes"]) for r in packs.classify(manifest, live, "pack", "blob", "n").collect()}
    assert got == {"p": ("reusable", 3, 3), "q": ("droppable", 4, 0), "r": ("sparse", 24, 8)}


def test_superseded_indexes_keep_their_word(spark):
    entries = spark.createDataFrame([("i1", "p"), ("i2", "q"), ("i3", "r")], "index_id string, pack_id string")
    gone = spark.createDataFrame([("i2", "i1"), ("i3", "i2")], "index_id string, superseded_id string")
    assert [r["pack_id"] for r in packs.master_index(entries, gone).collect()] == ["r"]


def test_pack_up_closes_when_full(spark):
    blobs = spark.createDataFrame([(f"b{i:03}", 40) for i in range(100)], "blob_id string, length long")
    rows = packs.pack_up(blobs, 100, 3).groupBy("lane", "pack_no").agg(F.sum("length").alias("n")).collect()
    assert sum(r["n"] for r in rows) == 4000 and max(r["n"] for r in rows) == 120
    assert sum(r["n"] < 100 for r in rows) <= 3


def test_resume(spark):
    frame = lambda *x: spark.createDataFrame([(i,) for i in x], "pack_id string")
    lost, upload = packs.resume(frame("a", "b", "c"), frame("a", "z"), frame("b"))
    assert [r[0] for r in lost.collect()] == ["c"] and [r[0] for r in upload.collect()] == ["a"]
    assert packs.contains_all(frame("a", "b"), frame("a"), "pack_id") and not packs.same_set(frame("a", "b"), frame("a"), "pack_id")


def test_cycles_and_shared_subtrees(spark):
    rows = [("r", "a", "directory", "s"), ("r", "b", "directory", "s"), ("s", "f", "file", None)]
    frame = spark.createDataFrame(rows, "tree_id string, name string, kind string, subtree string")
    roots = spark.createDataFrame([("r",)], "tree_id string")
    assert {"/".join(r["parts"]) for r in trees.unfold(frame, roots).collect()} == {"a", "b", "a/f", "b/f"}
    assert trees.unfold(frame, roots, recursive=False).count() == 2
    looped = frame.unionByName(spark.createDataFrame([("s", "back", "directory", "r")], frame.schema))
    with pytest.raises(trees.CycleError):
        trees.unfold(looped, roots)
    assert trees.unfold(looped, roots, strict=False).count() == 6


def test_empty_directories_have_the_empty_tree(spark):
    meta = "struct<meta_type:string,mode:long,size:long,uid:long,gid:long,atime_ns:long,mtime_ns:long,attributes:long,creation_ns:long>"
    row = ("posix", 1, None, 1, 1, 1, 1, None, None)
    entries = spark.createDataFrame([(0, ["d"], "directory", None, None, row)], f"snapshot_key int, parts array<string>, kind string, chunks array<string>, target string, meta {meta}")
    rows, blobs, roots = trees.build_trees(entries)
    assert rows.first()["subtree"] == cbor.EMPTY_TREE and roots.count() == 1
    assert cbor.EMPTY_TREE in {r["blob_id"] for r in blobs.collect()}


def test_kind_changes_in_diffs(spark):
    schema = "path string, kind string, chunks array<string>, target string"
    left = spark.createDataFrame([("a", "file", ["1"], None), ("b", "symlink", None, "x"), ("c", "directory", None, None), ("d", "file", ["2"], None)], schema)
    right = spark.createDataFrame([("a", "symlink", None, "y"), ("b", "symlink", None, "z"), ("c", "directory", None, None), ("d", "file", ["2", "2"], None)], schema)
    assert sorted((r["path"], r["code"]) for r in diff.compare(left, right, ["path"]).collect()) == [("a", "+"), ("a", "-"), ("b", "+"), ("b", "-"), ("d", "C")]


def test_restore_rules(spark):
    schema = "path string, kind string, chunks array<string>, target string"
    here = spark.createDataFrame([("dir", "directory", None, None), ("old", "file", ["1"], None), ("f", "file", ["1"], None)], schema)
    want = spark.createDataFrame([("dir", "file", ["2"], None), ("f", "directory", None, None)], schema)
    plan = lambda d: sorted((r["path"], r["code"]) for r in restore.plan(here, want, ["path"], d).collect())
    assert plan(False) == [("f", "+"), ("f", "-")]
    assert plan(True) == [("dir", "+"), ("dir", "-"), ("f", "+"), ("f", "-"), ("old", "-")]


def test_cache_keeps_what_crosses(spark):
    rows = spark.createDataFrame([("foo", 1, 4), ("baz", 2, 3)], "name string, t long, size long")
    gone = lambda n: [r["name"] for r in cache.evict(rows, n, "size", [F.desc("t")]).collect()]
    assert gone(3) == ["foo"] and gone(1) == ["foo"] and gone(4) == [] and gone(100) == []
    with pytest.raises(ValueError):
        gone(0)


def test_ranges_do_not_change_running_sums(spark, monkeypatch):
    monkeypatch.setattr(windows, "RANGE_ROWS", 7)
    frame = spark.range(100).select(F.pmod(F.xxhash64("id"), F.lit(30)).alias("k"), "id", (F.col("id") % 5).alias("v"))
    order = [F.col("k"), F.col("id")]
    assert windows.with_range(frame, order).select("__r").distinct().count() > 3
    got = windows.running_sum(frame, "v", order, "s").collect()
    total = 0
    for r in sorted(got, key=lambda r: (r["k"], r["id"])):
        assert r["s"] == total
        total += r["v"]
    before = None
    for r in sorted(windows.previous(frame, "v", order, "p").collect(), key=lambda r: (r["k"], r["id"])):
        assert r["p"] == before
        before = r["v"]


def test_skips_match_ancestors(spark):
    frame = spark.createDataFrame([("src/a/b",), ("src/c",), ("x/src",)], "path string")
    keep = lambda *p: [r["path"] for r in filters.keep_unskipped(frame, list(p)).collect()]
    assert keep("a$") == ["src/c", "x/src"] and keep("^src$") == ["x/src"] and keep() == ["src/a/b", "src/c", "x/src"]
    assert filters.merge_skips(["b", "a"], ["a"]) == ["a", "b"]


def test_stream_ingest_resumes(spark, tmp_path):
    schema = "blob_id string, n long"
    source, table, check = (str(tmp_path / x) for x in ("in", "table", "check"))
    spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], schema).coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    ingest.ingest(stream(), table, check).awaitTermination()
    spark.createDataFrame([("b", 2), ("c", 3)], schema).coalesce(1).write.mode("append").parquet(source)
    ingest.ingest(stream(), table, check).awaitTermination()
    assert sorted(r["blob_id"] for r in spark.read.parquet(table).collect()) == ["a", "b", "c"]


def scratch_tables(spark):
    where = scratch.scratch_dir(spark).removeprefix("file://") + "/siltstone"
    return set(os.listdir(where)) if os.path.isdir(where) else set()


def test_scratch_is_empty_after_a_scope(spark):
    before = scratch_tables(spark)
    with scratch.scope() as keep:
        first = scratch.materialize(spark.range(10), "first")
        kept = keep(scratch.materialize(first.where("id > 3"), "kept"))
        with scratch.scope():
            inner = scratch.materialize(first, "inner")
            assert inner.count() == 10
        names = {n.split("-")[0] for n in scratch_tables(spark) - before}
        assert names == {"first", "kept"}
    assert {n.split("-")[0] for n in scratch_tables(spark) - before} == {"kept"} and kept.count() == 6
    scratch.free(kept)
    assert scratch_tables(spark) == before


@pytest.mark.parametrize("name", ["tree_flatten", "merkle_rollup", "pack_binning", "tree_cycle_check"])
def test_scratch_is_empty_after_a_query(spark, tmp_path, name):
    before = scratch_tables(spark)
    with scratch.scope():
        QUERIES[name](spark, "/root/testdata/sf0.001").write.parquet(f"{tmp_path}/out")
        assert scratch_tables(spark) != before
    assert scratch_tables(spark) == before


def test_scratch_wants_a_shared_folder_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(scratch.ScratchError):
        scratch.scratch_dir(Session())
    Conf.get = lambda self, key, default=None: {"spark.master": "yarn", "spark.checkpoint.dir": "hdfs://x/y/"}.get(key, default)
    assert scratch.scratch_dir(Session()) == "hdfs://x/y"
