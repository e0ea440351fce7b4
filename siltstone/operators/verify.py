"""Checks that stored bytes are what their ids say."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import cbor, ids
from .trees import TREE


def corrupt_blobs(blobs: DataFrame, content: str, blob: str = "blob_id", bits: int = 224, text_ids: bool = False) -> DataFrame:
    """Blobs whose recomputed id differs from the stored one."""
    own = ids.object_id(F.col(content)) if text_ids else ids.digest(F.col(content), bits)
    return blobs.where(~own.eqNullSafe(F.col(blob))).withColumn("actual_id", own)


def verification_totals(blobs: DataFrame, content: str, pack: str, blob: str = "blob_id", bits: int = 224, text_ids: bool = False) -> DataFrame:
    """One row: packs and blobs read, and broken ones of each."""
    own = ids.object_id(F.col(content)) if text_ids else ids.digest(F.col(content), bits)
    packs = blobs.groupBy(pack).agg(F.count(F.lit(1)).alias("n"), F.count_if(~own.eqNullSafe(F.col(blob))).alias("bad"))
    return packs.agg(
        F.count(F.lit(1)).alias("packs"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("blobs"),
        F.count_if(F.col("bad") > 0).alias("broken_packs"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("broken_blobs"),
    )


def manifest_mismatches(own: DataFrame, indexed: DataFrame) -> DataFrame:
    """Entries (pack_id, seq, blob_type, length, blob_id) of which a pack's own manifest and the index differ."""
    a, b = own.alias("a"), indexed.alias("b")
    joined = a.join(b, ["pack_id", "seq"], "full_outer")
    same = F.lit(True)
    for c in ("blob_type", "length", "blob_id"):
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return joined.where(~same).select("pack_id", "seq", F.col("a.blob_id").alias("pack_blob"), F.col("b.blob_id").alias("index_blob"))


def wrong_names(rows: DataFrame, keys: list[str], name: str, order: list[str], entry: Column, bits: int = 224) -> DataFrame:
    """Groups whose stored name is not the digest of their entries' texts, joined by newlines in order:
    keys, name, actual."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct(*order, entry.alias("__text")))), lambda x: x["__text"])
    own = rows.groupBy(*keys, name).agg(F.sha2(F.array_join(texts, "\n"), bits).alias("actual"))
    return own.where(~F.col(name).eqNullSafe(F.col("actual")))


def _pack_name(table: pa.Table) -> pa.Table:
    table = table.sort_by("seq")
    own = cbor.pack_id(zip(*[table.column(c).to_pylist() for c in ("blob_type", "length", "blob_id")], strict=True))
    return pa.table({"pack_id": table.column("pack_id").slice(0, 1), "actual_id": pa.array([own])})


def wrong_packs(manifest: DataFrame) -> DataFrame:
    """Packs whose id is not that of their manifest (pack_id, seq, blob_type, length, blob_id): pack_id, actual_id."""
    rows = manifest.select("pack_id", "seq", "blob_type", "length", "blob_id")
    return rows.groupBy("pack_id").applyInArrow(_pack_name, "pack_id string, actual_id string").where("pack_id <> actual_id")


def wrong_snapshots(snapshots: DataFrame) -> DataFrame:
    """Snapshots whose id is not that of their fields: snapshot_id, actual_id."""
    fields = ["time_ns", "tz", "author", "tags", "paths", "tree_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[batch.column(c).to_pylist() for c in fields], strict=True)
            own = [cbor.snapshot_id(time, tz, author, tags or [], paths, tree) for time, tz, author, tags, paths, tree in rows]
            yield pa.RecordBatch.from_arrays([batch.column("snapshot_id"), pa.array(own, pa.string())], names=["snapshot_id", "actual_id"])

    return snapshots.select("snapshot_id", *fields).mapInArrow(run, "snapshot_id string, actual_id string").where("snapshot_id <> actual_id")


def wrong_indexes(entries: DataFrame, supersedes: DataFrame) -> DataFrame:
    """Indexes whose id is not that of their packs and of what they supersede: index_id, actual_id."""
    bucket = F.left("pack_id", F.lit(2)).alias("bucket")
    digests = entries.select("index_id", "pack_id").distinct().groupBy("index_id", bucket).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list("pack_id")), ""), 224).alias("digest")
    )
    packs = digests.groupBy("index_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "digest"))), lambda x: x["digest"]).alias("packs"))
    gone = supersedes.groupBy("index_id").agg(F.array_sort(F.collect_list("superseded_id")).alias("gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("packs").to_pylist(), batch.column("gone").to_pylist(), strict=True)
            own = [cbor.object_id(cbor.encode({"supersedes": g or [], "packs": [bytes.fromhex(d) for d in p]})) for p, g in rows]
            yield pa.RecordBatch.from_arrays([batch.column("index_id"), pa.array(own, pa.string())], names=["index_id", "actual_id"])

    rows = packs.join(gone, "index_id", "left").select("index_id", "packs", "gone")
    return rows.mapInArrow(run, "index_id string, actual_id string").where("index_id <> actual_id")


def decode_trees(blobs: DataFrame) -> DataFrame:
    """The entries of trees (blob_id, bytes), in the columns of ``TREE``. One that can't be decoded has one of name null."""
    named = T._parse_datatype_string(TREE)
    fields = named.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, data in zip(batch.column("blob_id").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                try:
                    rows = [{"tree_id": tree, **e} for e in cbor.tree_entries(data)]
                except (ValueError, KeyError, AttributeError, TypeError):
                    rows = [{"tree_id": tree, "name": None}]
                yield pa.RecordBatch.from_pylist([{c: r.get(c) for c in fields} for r in rows], to_arrow_schema(named))

    return blobs.select("blob_id", "bytes").dropDuplicates(["blob_id"]).mapInArrow(run, named)


def wrong_trees(blobs: DataFrame, trees: DataFrame) -> DataFrame:
    """Entries of which the rows of trees and the trees decoded from their blobs (blob_id, bytes) differ: tree_id, name."""
    own = decode_trees(blobs)
    fields = own.columns
    a, b = own.alias("a"), trees.select(*fields).alias("b")
    joined = a.join(b, F.expr("a.tree_id = b.tree_id and a.name = b.name"), "full_outer")
    same = F.lit(True)
    for c in fields:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return joined.where(~same).select(F.coalesce("a.tree_id", "b.tree_id").alias("tree_id"), F.coalesce("a.name", "b.name").alias("name"))
