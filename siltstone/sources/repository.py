"""A repository of snapshots as folders of Parquet.

    config.json
    packs/kind=K/bucket=B/pack_id=P/  blob_id, seq, length, bytes (B: the first symbols of P, so that no folder grows huge)
    trees/bucket=B/pack_id=P/      the rows of the trees in a tree pack
    indexes/index_id=I/            pack_id, seq, blob_type, length, blob_id
    supersedes/index_id=I/         superseded_id
    snapshots/snapshot_id=S/       time_ns, tz, author, tags, paths, tree_id

Parquet has no transactions, so writes are ordered: packs, then the index that names them, then the
snapshot; deletes go the other way. Names are content ids, so a repeated write is harmless. With a filter
command in the configuration the bytes of blobs are piped through it, and through its inverse when they are read.
"""

from __future__ import annotations

import json
import os
import subprocess
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cbor
from ..operators import packs as packing
from ..operators.trees import TREE
from ..scratch import delete_path, materialize
from . import objects

#: Bytes at which a pack closes.
PACK_SIZE = 100_000_000
FOLDERS = ("packs", "trees", "indexes", "supersedes", "snapshots")
_PACKS = "blob_id string, seq int, length long, bytes binary, kind string, bucket string, pack_id string"
#: Symbols of a pack's bucket: 1024 folders.
_BUCKET = 2
#: Deletions under way at once.
_DELETIONS = 32
_ENTRIES = "pack_id string, seq int, blob_type string, length long, blob_id string, index_id string"
_SNAPSHOTS = "time_ns long, tz string, author string, tags array<string>, paths array<string>, tree_id string, snapshot_id string"


class RepositoryError(RuntimeError):
    """A repository that can't be used as asked."""


def _name_pack(kind: str):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("blob_id")
        ids, lengths = table.column("blob_id").to_pylist(), table.column("length").to_pylist()
        name = cbor.pack_id((kind, n, i) for i, n in zip(ids, lengths, strict=True))
        n = len(ids)
        return pa.table(
            {"blob_id": table.column("blob_id"), "seq": pa.array(range(n), pa.int32()), "length": table.column("length"), "lane": table.column("lane"), "pack_no": table.column("pack_no"), "pack_id": pa.array([name] * n)}
        )

    return run


def bucket_of(pack: str = "pack_id") -> Column:
    return F.left(pack, F.lit(_BUCKET))


def pipe(data: bytes, command: str) -> bytes:
    """What a shell command makes of its input."""
    return subprocess.run(["sh", "-c", command], input=data, stdout=subprocess.PIPE, check=True).stdout


def piped(blobs: DataFrame, command: str | None) -> DataFrame:
    """Rows whose ``bytes`` went through a shell command, if there is one."""
    if not command:
        return blobs
    at = blobs.columns.index("bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.array([None if x is None else pipe(x, command) for x in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([out if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return blobs.mapInArrow(run, blobs.schema)


def index_name(manifest: DataFrame, supersedes: Iterable[str]) -> str | None:
    """An index's id: it hashes what it supersedes and, by bucket, its packs' ids (each of which hashes its manifest).
    The driver sees one digest a bucket, and none without packs."""
    names = manifest.select("pack_id").distinct().groupBy(bucket_of().alias("bucket")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list("pack_id")), ""), 224).alias("digest")
    )
    digests = [bytes.fromhex(r["digest"]) for r in names.orderBy("bucket").collect()]
    return cbor.object_id(cbor.encode({"supersedes": sorted(supersedes), "packs": digests})) if digests else None


class Repository:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- set-up

    def init(self, pack_size: int = PACK_SIZE, filter: str | None = None, unfilter: str | None = None) -> Repository:
        if objects.child_names(self.spark, self.root):
            raise RepositoryError(f"{self.root} is not empty")
        if (filter is None) != (unfilter is None):
            raise RepositoryError("give both a filter and its inverse, or neither")
        if filter is not None:
            sample = os.urandom(1 << 12)
            if pipe(pipe(sample, filter), unfilter) != sample:
                raise RepositoryError("the filter's inverse does not give its input back")
        config = {"pack_size": pack_size} | ({} if filter is None else {"filter": filter, "unfilter": unfilter})
        objects.write_text(self.spark, f"{self.root}/config.json", json.dumps(config))
        return self

    @property
    def config(self) -> dict:
        if not objects.exists(self.spark, f"{self.root}/config.json"):
            raise RepositoryError(f"{self.root} is no repository")
        return json.loads(objects.read_text(self.spark, f"{self.root}/config.json"))

    @property
    def pack_size(self) -> int:
        return self.config["pack_size"]

    # -- reading

    def _read(self, folder: str, schema: str) -> DataFrame:
        path = f"{self.root}/{folder}"
        if not objects.child_names(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", path).parquet(path)

    def blobs(self) -> DataFrame:
        """Blobs as stored; ``contents`` gives their bytes back."""
        return self._read("packs", _PACKS).drop("bucket")

    def contents(self, blobs: DataFrame) -> DataFrame:
        """Blobs with their bytes as they were before the filter."""
        return piped(blobs, self.config.get("unfilter"))

    def trees(self) -> DataFrame:
        """Rows of all indexed trees."""
        return self._read("trees", f"{TREE}, bucket string, pack_id string").dropDuplicates(["tree_id", "name"]).drop("bucket", "pack_id")

    def entries(self) -> DataFrame:
        """Entries of all indexes, superseded ones too."""
        return self._read("indexes", _ENTRIES)

    def supersedes(self) -> DataFrame:
        return self._read("supersedes", "superseded_id string, index_id string")

    def manifest(self) -> DataFrame:
        """Entries of the master index."""
        entries = self.entries()
        current = packing.master_index(entries.select("index_id", "pack_id").distinct(), self.supersedes())
        return entries.join(current, ["index_id", "pack_id"], "left_semi").drop("index_id")

    def snapshots(self) -> DataFrame:
        return self._read("snapshots", _SNAPSHOTS)

    def pack_names(self) -> DataFrame:
        """Packs that are there, by listing: (pack_id, kind)."""
        if not objects.child_names(self.spark, f"{self.root}/packs"):
            return self.spark.createDataFrame([], "pack_id string, kind string")
        name = F.col("name")
        found = objects.list_objects(self.spark, f"{self.root}/packs", pattern="*.parquet")
        return found.select(F.regexp_extract(name, "pack_id=([^/]+)", 1).alias("pack_id"), F.regexp_extract(name, "kind=([^/]+)", 1).alias("kind")).distinct()

    def pack_sizes(self) -> DataFrame:
        """Stored bytes of the packs that are there, by listing: (pack_id, bytes)."""
        if not objects.child_names(self.spark, f"{self.root}/packs"):
            return self.spark.createDataFrame([], "pack_id string, bytes long")
        found = objects.list_objects(self.spark, f"{self.root}/packs", pattern="*.parquet")
        return found.groupBy(F.regexp_extract("name", "pack_id=([^/]+)", 1).alias("pack_id")).agg(F.sum("bytes").alias("bytes"))

    def tree_pack_names(self) -> DataFrame:
        """Packs whose trees' rows are there: (pack_id)."""
        if not objects.child_names(self.spark, f"{self.root}/trees"):
            return self.spark.createDataFrame([], "pack_id string")
        found = objects.list_objects(self.spark, f"{self.root}/trees", pattern="*.parquet")
        return found.select(F.regexp_extract("name", "pack_id=([^/]+)", 1).alias("pack_id")).distinct()

    def index_names(self) -> list[str]:
        return [n.split("=", 1)[1] for n in objects.child_names(self.spark, f"{self.root}/indexes") if "=" in n]

    def objects(self) -> DataFrame:
        return objects.list_objects(self.spark, self.root, pattern="*.parquet")

    # -- writing

    def write_packs(self, blobs: DataFrame, kind: str, lanes: int | None = None, stored: bool = False) -> DataFrame:
        """Write blobs (blob_id, length, bytes) as packs; returns their manifest entries.

        Packs are formed and named on ids and lengths alone; bytes are shuffled once, to their packs. ``stored`` bytes
        went through the filter already."""
        blobs = blobs if stored else piped(blobs, self.config.get("filter"))
        blobs = materialize(blobs.select("blob_id", "length", "bytes"), "blobs")
        total = blobs.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
        lanes = lanes or max(1, min(1 << 20, total // (8 * self.pack_size)))
        placed = packing.pack_up(blobs.select("blob_id", "length"), self.pack_size, lanes)
        named = placed.groupBy("lane", "pack_no").applyInArrow(_name_pack(kind), "blob_id string, seq int, length long, lane int, pack_no int, pack_id string")
        named = materialize(named.select("blob_id", "seq", "length", "pack_id"), "manifest")
        filled = blobs.drop("length").join(named, "blob_id").select(
            "blob_id", "seq", "length", "bytes", F.lit(kind).alias("kind"), bucket_of().alias("bucket"), "pack_id",
        )
        filled.repartition(F.col("pack_id")).sortWithinPartitions("pack_id", "seq").write.mode("append").option("compression", "zstd").partitionBy("kind", "bucket", "pack_id").parquet(
            f"{self.root}/packs"
        )
        return named.select("pack_id", "seq", F.lit(kind).alias("blob_type"), "length", "blob_id")

    def write_trees(self, rows: DataFrame, manifest: DataFrame) -> None:
        """Write the rows of trees next to the tree packs that hold them."""
        own = rows.join(manifest.where("blob_type = 'tree'").select(F.col("blob_id").alias("tree_id"), "pack_id"), "tree_id")
        own.withColumn("bucket", bucket_of()).repartition(F.col("pack_id")).write.mode("append").partitionBy("bucket", "pack_id").parquet(f"{self.root}/trees")

    def write_index(self, manifest: DataFrame, supersedes: Iterable[str] = ()) -> str | None:
        """Write an index of packs that supersedes others."""
        supersedes = sorted(supersedes)
        name = index_name(manifest, supersedes)
        if name is None:
            return None
        if twice := manifest.groupBy("pack_id", "seq").count().where("count > 1").take(1):
            raise RepositoryError(f"pack {twice[0]['pack_id']} is listed twice")
        if supersedes:
            self.spark.createDataFrame(
                [(s, name) for s in supersedes],
                "superseded_id string, index_id string",
            ).write.mode("append").partitionBy("index_id").parquet(f"{self.root}/supersedes")
        manifest.withColumn("index_id", F.lit(name)).write.mode("append").partitionBy("index_id").parquet(f"{self.root}/indexes")
        return name

    def write_snapshot(self, time_ns: int, tz: str, author: str, tags: Iterable[str], paths: Iterable[str], tree_id: str) -> str:
        tags, paths = sorted(set(tags)), sorted(set(paths))
        name = cbor.snapshot_id(time_ns, tz, author, tags, paths, tree_id)
        if not objects.exists(self.spark, f"{self.root}/snapshots/snapshot_id={name}"):
            row = self.spark.createDataFrame([(time_ns, tz, author, tags, paths, tree_id, name)], _SNAPSHOTS)
            row.coalesce(1).write.mode("append").partitionBy("snapshot_id").parquet(f"{self.root}/snapshots")
        return name

    # -- deleting

    def remove_snapshots(self, names: Iterable[str]) -> None:
        for n in names:
            delete_path(self.spark, f"{self.root}/snapshots/snapshot_id={n}")

    def remove_indexes(self, names: Iterable[str]) -> None:
        for n in names:
            delete_path(self.spark, f"{self.root}/indexes/index_id={n}")
            delete_path(self.spark, f"{self.root}/supersedes/index_id={n}")

    def remove_packs(self, packs: DataFrame) -> None:
        """Delete packs (kind, pack_id). Their names stream through the driver, a partition at a time; stores delete
        many at once."""

        def remove(row) -> None:
            below = f"bucket={row['pack_id'][:_BUCKET]}/pack_id={row['pack_id']}"
            delete_path(self.spark, f"{self.root}/packs/kind={row['kind']}/{below}")
            if row["kind"] == "tree":
                delete_path(self.spark, f"{self.root}/trees/{below}")

        with ThreadPoolExecutor(_DELETIONS) as pool:
            under_way: list = []
            for row in packs.toLocalIterator():
                under_way.append(pool.submit(remove, row))
                if len(under_way) >= 4 * _DELETIONS:
                    under_way.pop(0).result()
            for each in under_way:
                each.result()
