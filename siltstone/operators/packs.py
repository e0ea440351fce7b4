"""Packs, their manifests and indexes: what lives, what is missing, what to rewrite."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import running_sum


def master_index(entries: DataFrame, supersedes: DataFrame, index: str = "index_id", superseded: str = "superseded_id", pack: str = "pack_id") -> DataFrame:
    """Entries of all indexes that no loaded index supersedes (a superseded one's word counts too), packs once.

    ``entries`` has one row for an index and pack."""
    gone = supersedes.select(F.col(superseded).alias(index)).distinct()
    return entries.join(gone, index, "left_anti").dropDuplicates([pack])


def reachable(refs: DataFrame, blob: str) -> DataFrame:
    """Distinct blobs that snapshots reach."""
    return refs.select(blob).where(F.col(blob).isNotNull()).distinct()


def classify(manifest: DataFrame, live: DataFrame, pack: str, blob: str, length: str) -> DataFrame:
    """One row per pack: its class, entries and bytes in all and live.

    reusable: every entry is reachable; droppable: none is; sparse: some are.
    """
    flag = live.select(blob).distinct().withColumn("__live", F.lit(1))
    marked = manifest.join(flag, blob, "left")
    out = marked.groupBy(pack).agg(
        F.count(F.lit(1)).alias("entries"),
        F.count("__live").alias("live_entries"),
        F.sum(length).alias("bytes"),
        F.coalesce(F.sum(F.when(F.col("__live") == 1, F.col(length))), F.lit(0)).alias("live_bytes"),
    )
    kind = F.when(F.col("live_entries") == F.col("entries"), "reusable").when(F.col("live_entries") == 0, "droppable").otherwise("sparse")
    return out.withColumn("class", kind)


def class_totals(classes: DataFrame) -> DataFrame:
    return classes.groupBy("class").agg(F.count(F.lit(1)).alias("packs"), F.sum("bytes").alias("bytes"), F.sum("live_bytes").alias("live_bytes"))


def to_repack(manifest: DataFrame, live: DataFrame, classes: DataFrame, pack: str, blob: str) -> DataFrame:
    """Reachable blobs that no reusable pack holds, each once."""
    kept = manifest.join(classes.where(F.col("class") == "reusable").select(pack), pack, "left_semi").select(blob)
    return manifest.select(blob).distinct().join(live.select(blob), blob, "left_semi").join(kept, blob, "left_anti")


def prune_plan(manifest: DataFrame, live: DataFrame, pack: str, blob: str, length: str) -> DataFrame:
    """Action by pack: keep, rewrite or drop, with its bytes in all and live."""
    action = F.when(F.col("class") == "reusable", "keep").when(F.col("class") == "sparse", "rewrite").otherwise("drop")
    return classify(manifest, live, pack, blob, length).select(pack, action.alias("action"), "bytes", "live_bytes")


def missing(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Distinct keys that are wanted and not present (packs indexed but not listed, or the reverse)."""
    return wanted.select(key).distinct().join(present.select(key), key, "left_anti")


def missing_chunks(refs: DataFrame, manifest: DataFrame, chunk: str, snapshot: str) -> DataFrame:
    """Chunks that snapshots use and no pack holds, with the number of snapshots and the first.

    The anti-join goes first, so only missing chunks are aggregated."""
    lost = refs.select(chunk, snapshot).join(manifest.select(chunk).distinct(), chunk, "left_anti").distinct()
    return lost.groupBy(chunk).agg(F.count(F.lit(1)).alias("snapshots"), F.min(snapshot).alias("first_snapshot"))


def users(refs: DataFrame, chunk: str, snapshot: str) -> DataFrame:
    """Chunk to the sorted set of snapshots that use it."""
    return refs.groupBy(chunk).agg(F.array_sort(F.collect_set(snapshot)).alias("snapshots"))


def bins(manifest: DataFrame, length: str, target: int, order: list[Column], out: str = "bin") -> DataFrame:
    """Bins by running size: rows fall into the bin of the bytes before them over ``target``."""
    return running_sum(manifest, length, order, "__before").withColumn(out, F.floor(F.col("__before") / target).cast("long")).drop("__before")


def pack_up(blobs: DataFrame, target: int, lanes: int, blob: str = "blob_id", length: str = "length", lane: Column | None = None) -> DataFrame:
    """Assign blobs to packs that close when they reach ``target``, running anew in each of ``lanes`` (as parallel
    packers do): adds lane and pack_no. A pack overshoots by one blob at most and splits none. ``lane`` is a hash
    of the id unless given."""
    names = [f.name for f in blobs.schema.fields]
    at = names.index(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, number, filled = None, 0, 0
        for batch in batches:
            out = []
            for x, own in zip(batch.column(at).to_pylist(), batch.column("lane").to_pylist(), strict=True):
                if own != lane:
                    lane, number, filled = own, 0, 0
                elif filled >= target:
                    number, filled = number + 1, 0
                out.append(number)
                filled += x
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], names=[*batch.schema.names, "pack_no"])

    laned = blobs.withColumn("lane", (F.pmod(F.xxhash64(blob), F.lit(lanes)) if lane is None else lane).cast("int"))
    dealt = laned.repartitionByRange(lanes, "lane").sortWithinPartitions("lane", blob)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
    return dealt.mapInArrow(run, f"{kinds}, pack_no int")


def resume(wip: DataFrame, local: DataFrame, remote: DataFrame, pack: str = "pack_id") -> tuple[DataFrame, DataFrame]:
    """For a partial index left by an interrupted run: packs found nowhere (it is usable if there are
    none), and packs to upload (local, and in the partial index)."""
    lost = wip.select(pack).distinct().join(local.select(pack), pack, "left_anti").join(remote.select(pack), pack, "left_anti")
    return lost, local.join(wip.select(pack).distinct(), pack, "left_semi")


def same_set(a: DataFrame, b: DataFrame, key: str) -> bool:
    """Whether two tables hold the same keys."""
    return contains_all(a, b, key) and contains_all(b, a, key)


def contains_all(big: DataFrame, small: DataFrame, key: str) -> bool:
    return missing(small, big, key).isEmpty()
