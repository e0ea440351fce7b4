"""Ids, encodings, sizes, paths, times, chunking: fixed values and properties."""

import datetime
import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import cbor, ids, kinds, paths, sizes, times
from siltstone.operators import chunking
from siltstone.sources import config

SENTENCE = "Developers, developers, developers, developers!"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def ns(text):
    second, part = text.split(".")
    return int(datetime.datetime.fromisoformat(second + "+00:00").timestamp()) * 10**9 + int(part)


def test_fixed_ids(spark):
    h = cbor.object_id
    assert one(spark, ids.digest(F.lit(SENTENCE))) == "354e63924f01c3b921222ab4d5b4a77ef67d04bedf437eef66d2e0d6"
    assert cbor.EMPTY_TREE == "731btatro1tsc4b9erd6p9dm5n1l1r2tjqp4nk3885aku"
    assert cbor.pack_id([("chunk", 42, h(b"first")), ("tree", 22, h(b"second")), ("chunk", 42, h(b"third"))]) == "7c3gq0qmkioptdivd2iid0j3s7u7coci7vmluicktm20q"
    packs = {
        h(b"pack o' chunks"): [("chunk", 42, h(b"a chunk")), ("chunk", 9001, h(b"another chunk"))],
        h(b"pack o'trees"): [("tree", 182, h(b"first tree")), ("tree", 22, h(b"second tree")), ("tree", 11, h(b"third tree"))],
    }
    assert cbor.index_id([h(b"Some previous index"), h(b"Another previous index")], packs) == "e3vr9p4gmumq8i1dafgum50iirupu6ahk9fn6c781b09a"
    first = cbor.snapshot_v1_bytes("1969-07-20T20:17:40+00:00[UTC]", "Neil", ["Apollo", "NASA"], ["moon/orbit", "moon/tranquility-base"], h(b"One small step"))
    assert h(first) == "4t84ab7sgsjjss803e30mdrokbnibg7ubpb4leds2e91g"
    tree = [
        {"name": "UnixFileNode", "kind": "file", "chunks": [h(b"first chunk"), h(b"second chunk"), h(b"third chunk")], "meta": {"meta_type": "posix", "mode": 0o644, "size": 42, "uid": 1234, "gid": 5678, "atime_ns": ns("2020-10-30T06:30:25.157873535"), "mtime_ns": ns("2020-10-30T06:30:25.034542588")}},
        {"name": "WindowsDirNode", "kind": "directory", "subtree": h(b"some subdirectory"), "meta": {"meta_type": "windows", "attributes": 0xDEADBEEF, "size": None, "creation_ns": None, "atime_ns": ns("2020-10-29T09:11:05.701157660"), "mtime_ns": ns("2020-10-24T01:22:27.624697907")}},
    ]
    assert cbor.tree_id(tree) == "8orh4h6b5dbmv2d7g0hu46rgsfhre7477kn9lgp97cqbe"


def test_base32_expression_matches(spark):
    texts = [f"text {i}" for i in range(50)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ids.object_id(F.col("t")).alias("id")).withColumn("hex", ids.base32_to_hex(F.col("id"))).collect()
    for r in rows:
        assert r["id"] == cbor.object_id(r["t"].encode()) and r["hex"] == hashlib.sha224(r["t"].encode()).hexdigest()
        assert cbor.id_text(cbor.id_bytes(r["id"])) == r["id"]
    fine = "blfqkdj95s6h1vbauaarc9v6j5291mv5l7893i0bl626q"
    assert one(spark, ids.is_id(F.lit(fine))) and not one(spark, ids.is_id(F.lit(fine.upper()))) and not one(spark, ids.is_id(F.lit(fine[1:])))
    assert one(spark, ids.base32_to_hex(F.lit("nonsense"))) is None and one(spark, ids.short_id(F.lit(fine))) == fine[:8]


@pytest.mark.parametrize(("size", "text"), [(0, "0 B"), (999, "999 B"), (1000, "1 KB"), (281_499, "281 KB"), (1_234_567, "1.23 MB"), (16_480_000_000, "16.48 GB"), (5 * 10**12, "5.00 TB")])
def test_human_size(spark, size, text):
    assert one(spark, sizes.human_size(F.lit(size).cast("long"))) == text


@pytest.mark.parametrize(("text", "size"), [("4096", 4096), ("100 MB", 10**8), ("1.5 GiB", 3 << 29), ("10k", 10_000), ("7b", 7), ("x", None), ("", None)])
def test_parse_size(spark, text, size):
    assert one(spark, sizes.parse_size(F.lit(text))) == size


def test_paths(spark):
    rows = ["a/b", "a.txt", "a", "/x/y/", "a/b/c"]
    frame = spark.createDataFrame([(r,) for r in rows], "p string")
    assert [r["p"] for r in frame.orderBy(paths.parts(F.col("p"))).collect()] == ["a", "a/b", "a/b/c", "a.txt", "/x/y/"]
    get = {r["p"]: r for r in frame.select("p", paths.ancestors(F.col("p")).alias("up"), paths.last_component(F.col("p")).alias("last"), paths.strip_prefix(F.col("p"), F.lit("a")).alias("rest"), paths.has_trailing_slash(F.col("p")).alias("slash")).collect()}
    assert get["a/b/c"]["up"] == ["a", "a/b", "a/b/c"] and get["/x/y/"]["up"] == ["/x", "/x/y"]
    assert get["a/b/c"]["rest"] == "b/c" and get["a.txt"]["rest"] is None and get["a"]["rest"] == ""
    assert get["/x/y/"]["last"] == "y" and get["/x/y/"]["slash"]
    assert one(spark, paths.destination(F.lit("abc.pack"))) == "packs/abc.pack" and one(spark, paths.destination(F.lit("abc.tmp"))) is None
    assert one(spark, paths.id_from_path(F.lit("packs/abc.pack"))) == "abc"
    assert one(spark, paths.is_plain_relative(F.lit("a/b"))) and not one(spark, paths.is_plain_relative(F.lit("a/../b")))


def test_times(spark):
    moment = 1_604_039_425_157_873_535
    assert one(spark, times.to_text(F.lit(moment))) == "2020-10-30T06:30:25.157873535Z"
    assert one(spark, times.to_text(F.lit(-1))) == "1969-12-31T23:59:59.999999999Z"
    assert one(spark, times.parse(F.lit("2020-10-30T07:30:25.157873535+01:00[Europe/Paris]"))) == moment
    assert one(spark, times.parse(F.lit("no time"))) is None
    assert one(spark, times.from_filetime(F.lit(0).cast("long"))) is None and one(spark, times.from_filetime(F.lit(116_444_736_000_000_010).cast("long"))) == 1000
    assert one(spark, times.display(F.lit(moment))) == "Fri Oct 30 2020 06:30:25"
    assert one(spark, F.unix_micros(times.to_timestamp(F.lit(moment)))) == moment // 1000


def test_settings(tmp_path):
    main, local = tmp_path / "main.toml", tmp_path / "local.toml"
    main.write_text('cache_size = "2 GB"\nskips = ["a"]\n[backup]\ndereference = true\n[restore]\noutput = "x"\n')
    assert config.load(None) == config.Settings() and config.load(main, local) == config.Settings(2 * 10**9, ["a"], True, "x")
    local.write_text('cache_size = 5\nskips = ["b"]\n')
    both = config.load(main, local)
    assert both == config.Settings(2 * 10**9, ["b"], True, "x") and both.skips_with(["c", "b"]) == ["b", "c"]
    assert config.load(None, local).skips == ["b"] and config._bytes("1 GiB") == 1 << 30
    with pytest.raises(ValueError):
        config._bytes("lots")


def test_kinds(spark):
    for mode, kind in ((0o100644, "file"), (0o040755, "directory"), (0o120777, "symlink"), (0o140777, None), (0o020666, None)):
        assert one(spark, kinds.kind_of_mode(F.lit(mode))) == kind
    assert [one(spark, kinds.kind_of_attributes(F.lit(a))) for a in (0x410, 0x10, 0x20)] == ["symlink", "directory", "file"]


def test_cuts():
    rng = random.Random(1)
    data = rng.randbytes(300_000)
    ends = chunking.cuts(data, 1024, 4096, 16384)
    sizes_ = [b - a for a, b in zip([0, *ends], ends, strict=False)]
    assert ends[-1] == len(data) and max(sizes_) <= 16384 and min(sizes_[:-1]) >= 1024
    assert 2500 < len(data) / len(sizes_) < 9000
    # an insertion moves few cuts
    other = data[:100_000] + b"inserted" + data[100_000:]
    chunks = lambda d: {d[a:b] for e in [chunking.cuts(d, 1024, 4096, 16384)] for a, b in zip([0, *e], e, strict=False)}
    assert len(chunks(data) & chunks(other)) > 0.9 * len(sizes_)
    assert chunking.cuts(b"") == [] and chunking.cuts(b"x") == [1] and chunking.cuts(bytes(6934)) == [6934]


def slow_cuts(data, minimum, target, maximum):
    table, bits = [int(x) for x in chunking.gear()], target.bit_length() - 1
    out, start = [], 0
    while start < len(data):
        stop = min(len(data), start + maximum)
        end, h = stop, 0
        if stop - start > minimum:
            for i in range(max(start, start + minimum - 63), stop):
                h = (h * 2 + table[data[i]]) % (1 << 64)
                if i >= start + minimum and not h & chunking._mask(bits + 1 if i < start + max(target, minimum) else bits - 1):
                    end = i + 1
                    break
        out.append(end)
        start = end
    return out


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 2**32), st.integers(0, 6000))
def test_cuts_match_the_rolling_definition(seed, n):
    data = random.Random(seed).randbytes(n)
    assert chunking.cuts(data, 64, 256, 1024) == slow_cuts(data, 64, 256, 1024)


def test_chunks_put_together_again(spark):
    rng = random.Random(3)
    rows = [(1, bytearray(rng.randbytes(20_000))), (2, bytearray(b"")), (3, None), (4, bytearray(b"abc"))]
    out = chunking.content_chunks(spark.createDataFrame(rows, "k long, c binary"), "k", "c", 256, 1024, 4096).collect()
    for k, content in rows:
        own = sorted((r for r in out if r["k"] == k), key=lambda r: r["seq"])
        assert b"".join(bytes(r["bytes"]) for r in own) == bytes(content or b"")
        assert all(r["blob_id"] == cbor.object_id(bytes(r["bytes"])) and r["length"] == len(r["bytes"]) for r in own)


def test_cbor_decodes_what_it_encodes():
    rng = random.Random(2)

    def value(depth=0):
        kind = rng.randrange(7 if depth < 3 else 5)
        if kind == 0:
            return rng.choice([None, True, False])
        if kind == 1:
            return rng.choice([0, 23, 24, 255, 256, 65536, 2**32, -1, -24, -25, -(2**40)])
        if kind == 2:
            return rng.randbytes(rng.choice([0, 5, 30, 300]))
        if kind in (3, 4):
            return "é" * rng.choice([0, 3, 30, 300])
        if kind == 5:
            return [value(depth + 1) for _ in range(rng.randrange(30))]
        return {str(i): value(depth + 1) for i in range(rng.randrange(30))}

    for _ in range(300):
        x = value()
        assert cbor.decode(cbor.encode(x)) == x
    data = cbor.encode({"a": [1, "x"]})
    for i in range(len(data)):
        with pytest.raises(ValueError, match="."):
            cbor.decode(data[:i])
    some = [cbor.object_id(bytes([i])) for i in range(3)]
    meta = {"meta_type": "posix", "mode": 0o644, "size": 7, "uid": 1, "gid": 2, "atime_ns": 3, "mtime_ns": -4, "attributes": None, "creation_ns": None}
    entries = [{"name": "a", "kind": "file", "chunks": some[:2], "subtree": None, "target": None, "meta": meta}]
    entries.append({"name": "b", "kind": "directory", "chunks": None, "subtree": some[2], "target": None, "meta": meta | {"size": None}})
    entries.append({"name": "c", "kind": "symlink", "chunks": None, "subtree": None, "target": "a", "meta": meta | {"size": None}})
    assert cbor.tree_entries(cbor.tree_bytes(entries)) == entries
    two = cbor.snapshot_of(cbor.snapshot_bytes(5, "UTC", "me", ["x"], ["/p"], some[0]))
    assert two == {"author": "me", "tags": ["x"], "paths": ["/p"], "tree_id": some[0], "time_ns": 5, "tz": "UTC"}
    one = cbor.snapshot_of(cbor.snapshot_v1_bytes("2024-01-01T00:00:00Z", "me", [], ["/p"], some[0]))
    assert one == {"author": "me", "tags": [], "paths": ["/p"], "tree_id": some[0], "time": "2024-01-01T00:00:00Z"}
