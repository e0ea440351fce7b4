"""Near-duplicate detection: MinHash bands for candidates, odd sketches to verify them, full sets to confirm.

1. One pass over whole texts gives each row's shingle-set digest, its band keys (``BANDS`` bands of
   ``ROWS`` MinHash values) and an odd sketch: a bitmap whose bit h(i, value i) flips for each of the
   samples. The XOR of two sketches counts differing samples, which estimates the similarity.
2. Rows with equal sets form a class, named by the number of its first row; only that row goes on.
3. Star round: in each band bucket, members pair with the bucket's least. Pairs whose sketches
   estimate the threshold less ``MARGIN`` are confirmed on full sets; components follow.
4. Exact rest: buckets that still hold several components are cut into groups of sets whose sizes allow the
   threshold at all. In each group all pairs between components are compared by sketch, ids and sketches only; a group
   of more than ``BLOCK`` members goes by pairs of half blocks. What passes is packed into parts bounded in
   rows and shingles, and pairs of parts are confirmed on full sets. Only spanning links between components
   leave a task, so output is linear in the members, and no partner is capped.

With 32 bands of 4 values, a pair at similarity 0.85 (0.8) shares no bucket with probability 6e-11
(5e-8); the margin is over five standard deviations of the sketch's estimate.

Defined cases: null, empty and wordless texts have an empty set and are linked with nothing; rows
that share a doc_id are one node, linked by each of their texts; rows with null doc_id are not linked (component
null, kept); repeated rows give repeated results; a very long text is hashed by pieces and its set must fit in a
task; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scope
from .components import connected_components
from .textbytes import buffers, mixed, shingle_sets, slices

BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
BITS = 256
MARGIN = 0.2
#: Members of a group that one task compares by sketch, and partners of one star that are confirmed in one.
BLOCK, STAR = 2048, 512
#: Rows and shingles of a part; a task confirms two parts (a set of more shingles is a part of its own).
PART_ROWS, PART_SHINGLES = 512, 1 << 20
SKETCH = [f"s{i}" for i in range(BITS // 64)]


def _seeds(n: int, seed: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def signatures(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """MinHash samples (texts x SAMPLES) of nonempty sets laid end to end."""
    out = np.empty((SAMPLES, len(at) - 1), np.uint64)
    scratch = np.empty_like(values)
    for i, s in enumerate(_seeds(SAMPLES, 5)):
        np.multiply(values ^ (s >> np.uint64(7)), s, out=scratch)
        np.minimum.reduceat(scratch, at[:-1], out=out[i])
    return out.T


def band_keys(samples: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(samples), BANDS), np.uint64)
    for r in range(ROWS):
        keys = mixed(keys + samples[:, r::ROWS])
    return mixed(keys + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps as BITS / 64 longs per text."""
    bit = (mixed(samples + np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) % np.uint64(BITS)).astype(np.int64)
    out = np.zeros((len(samples), BITS), np.uint8)
    for i in range(SAMPLES):
        out[np.arange(len(samples)), bit[:, i]] ^= 1
    return np.packbits(out, axis=1, bitorder="little").view(np.int64)


def most_differing_bits(threshold: float) -> int:
    """The largest XOR count whose estimate reaches the threshold less the margin.

    The estimate is 1 + BITS / (4 SAMPLES) ln(1 - 2 z / BITS) for z differing bits.
    """
    return int(BITS / 2 * (1 - np.exp(-4 * SAMPLES / BITS * (1 - threshold + MARGIN))))


def _signed(k: int):
    schema = pa.schema(
        [("row", pa.int64()), ("doc_id", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bands", pa.list_(pa.int64())), *[(s, pa.int64()) for s in SKETCH]]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            keys = [batch.column(c) for c in ("row", "doc_id", "h")]
            for a, b in slices(offsets):
                values, at = shingle_sets(data, offsets[a : b + 1], k)
                sizes = np.diff(at)
                full = np.flatnonzero(sizes)
                d1, d2 = np.zeros(b - a, np.uint64), np.zeros(b - a, np.uint64)
                bands, sketch = np.zeros((b - a, 0), np.int64), np.zeros((b - a, len(SKETCH)), np.int64)
                lists = np.zeros(b - a + 1, np.int64)
                if len(full):
                    begins = at[full]
                    d1[full] = np.add.reduceat(mixed(values + np.uint64(1)), begins)
                    d2[full] = np.bitwise_xor.reduceat(mixed(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), begins) + np.add.reduceat(values * values, begins)
                    samples = signatures(values, np.append(begins, at[-1]))
                    bands = band_keys(samples)
                    sketch[full] = odd_sketches(samples)
                    lists[1:] = np.cumsum(np.where(sizes > 0, BANDS, 0))
                yield pa.RecordBatch.from_arrays(
                    [
                        *[c[a:b] for c in keys],
                        *[pa.array(x) for x in (sizes, d1.view(np.int64), d2.view(np.int64))],
                        pa.ListArray.from_arrays(pa.array(lists.astype(np.int32)), pa.array(bands.reshape(-1))),
                        *[pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(len(SKETCH))],
                    ],
                    schema=schema,
                )

    return run


SIGNED = "row long, doc_id long, h long, n long, d1 long, d2 long, bands array<long>, " + ", ".join(f"{s} long" for s in SKETCH)


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm_stars(k: int, percent: int):
    """Rows sorted by (rep, chunk), the representative's first: links (u, v) that hold on full sets."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own = None, None
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            reps, ids = batch.column("rep").to_numpy(), batch.column("id").to_numpy()
            out = []
            for a, b in slices(offsets):
                values, at = shingle_sets(data, offsets[a : b + 1], k)
                for i in range(a, b):
                    mine = values[at[i - a] : at[i - a + 1]]
                    if ids[i] == reps[i]:
                        head, own = reps[i], mine.copy()
                    elif head == reps[i] and _linked(own, mine, percent):
                        out.append((ids[i], reps[i]))
            u, v = np.array(out, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(u)), pa.array(np.ascontiguousarray(v))], schema=schema)

    return run


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))


def _near(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Which pairs of rows of ``x`` and ``y`` differ in at most ``most`` bits."""
    out = np.empty((len(x), len(y)), bool)
    for a in range(0, len(x), 256):
        z = np.zeros((len(x[a : a + 256]), len(y)), np.uint16)
        for i in range(x.shape[1]):
            z += _bits(x[a : a + 256, i, None] ^ y[None, :, i])
        out[a : a + 256] = z <= most
    return out


def parts_of(sizes: np.ndarray) -> list[np.ndarray]:
    """Consecutive numbers in parts of at most PART_ROWS rows and PART_SHINGLES shingles, or of one row."""
    out, first, held = [], 0, 0
    for i, n in enumerate(sizes):
        if i > first and (i - first >= PART_ROWS or held + n > PART_SHINGLES):
            out.append(np.arange(first, i))
            first, held = i, 0
        held += n
    return [*out, np.arange(first, len(sizes))]


def _candidates(most: int, percent: int):
    """Members of one block of a group that are near, by sketch, to a member of another component, by pairs of parts."""
    names = ["key", "cell", "block", "id", "component", *SKETCH]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("component", "ascending"), ("id", "ascending")])
        sketch = np.stack([table.column(s).to_numpy() for s in SKETCH], axis=1)
        comp, n, own = (table.column(c).to_numpy() for c in ("component", "n", "own_cell"))
        near = _near(sketch, sketch, most)
        np.logical_and(near, comp[:, None] != comp[None, :], out=near)
        np.logical_and(near, 100 * n[:, None] >= percent * n[None, :], out=near)
        np.logical_and(near, near.T.copy(), out=near)
        here = own == table.column("cell")[0].as_py()
        near[np.ix_(~here, ~here)] = False  # those meet in a cell of their own
        some = np.flatnonzero(near.any(axis=1))
        parts = [some[p] for p in parts_of(n[some])] if len(some) else []
        rows, pair = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, p in enumerate(parts):
            for j, q in enumerate(parts[: i + 1]):
                meet = near[np.ix_(p, q)]
                found = np.union1d(p[meet.any(axis=1)], q[meet.any(axis=0)])
                rows.append(found)
                pair.append(np.full(len(found), i * (i + 1) // 2 + j))
        out = table.select(names).take(pa.array(np.concatenate(rows)))
        return out.append_column("pair", pa.array(np.concatenate(pair).astype(np.int64)))

    return run


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of column blocks of the incidence matrix."""
    n = len(sets)
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(n), [len(s) for s in sets])
    shared = counts > 1
    column = np.cumsum(shared) - 1
    use = shared[inverse]
    rows, cols = rows[use], column[inverse[use]]
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    total, width = np.zeros((n, n)), 2048  # a product of so few columns is exact in float32
    for first in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(cols, [first, first + width])
        part = np.zeros((n, width), np.float32)
        part[rows[a:b], cols[a:b] - first] = 1
        total += part @ part.T
    return total


def _confirm_rest(k: int, percent: int, most: int):
    """Spanning links between components among the members of one pair of parts, confirmed on full sets."""

    def run(table: pa.Table) -> pa.Table:
        comp = table.column("component").to_numpy()
        data, offsets = buffers(table.column("text"))
        sets = []
        for a, b in slices(offsets):
            values, at = shingle_sets(data, offsets[a : b + 1], k)
            sets += [values[at[i] : at[i + 1]] for i in range(b - a)]
        size = np.array([len(s) for s in sets], np.float64)
        sketch = np.stack([table.column(s).to_numpy() for s in SKETCH], axis=1)
        both = _overlaps(sets)
        link = (100 * both >= percent * (size[:, None] + size[None, :] - both)) & (comp[:, None] != comp[None, :]) & _near(sketch, sketch, most)
        label = np.arange(len(comp))
        while True:
            low = np.minimum(label, np.where(link, label[None, :], len(comp)).min(axis=1, initial=len(comp)))
            if (low == label).all():
                break
            label = low
        far = label != np.arange(len(comp))
        return pa.table({"u": pa.array(comp[far]), "v": pa.array(comp[label[far]])})

    return run


DIGEST = ["d1", "d2", "n"]


def _star_links(docs: DataFrame, reps: DataFrame, members: DataFrame, k: int, percent: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(texts of the members, links u, v between members and the least of their buckets)."""
    sketches = reps.select("id", *SKETCH)
    pairs = members.where("id <> rep").select("id", "rep").distinct()
    of_rep = sketches.select(F.col("id").alias("rep"), *[F.col(s).alias(f"r{s}") for s in SKETCH])
    differing = sum(F.bit_count(F.col(s).bitwiseXOR(F.col(f"r{s}"))) for s in SKETCH)
    pairs = materialize(pairs.join(sketches, "id").join(of_rep, "rep").where(differing <= most).select("id", "rep"), "near-pairs")
    # A text is found by its row's id and hash; exact repeats of a row are the same text.
    wanted = materialize(reps.join(members.select("id").distinct(), "id", "left_semi").select("id", F.col("doc_id").alias("own"), "h"), "near-wanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("own"), F.xxhash64("text").alias("h"), "text")
    # The ids wanted grow with the input: no broadcast, at any size.
    texts = materialize(texts.join(wanted.hint("merge"), ["own", "h"]).select("id", "text").dropDuplicates(["id"]), "near-texts")
    count = pairs.groupBy("rep").agg(F.count(F.lit(1)).alias("c")).select("rep", F.expr(f"(c + {STAR - 1}) div {STAR}").alias("chunks"))
    count = materialize(count, "near-stars")  # a plain join side, so that Spark can split a hot star's rows
    stars = pairs.join(count, "rep").select("rep", "id", F.pmod(F.xxhash64("id"), "chunks").alias("chunk"))
    heads = count.select("rep", F.col("rep").alias("id"), F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk"))
    with_text = stars.unionByName(heads).join(texts, "id")
    grouped = with_text.repartition(F.col("rep"), F.col("chunk")).sortWithinPartitions("rep", "chunk", F.col("id") != F.col("rep"))
    return texts, materialize(grouped.select("rep", "id", "text").mapInArrow(_confirm_stars(k, percent), "u long, v long"), "near-links")


def _other_links(reps: DataFrame, texts: DataFrame, held: DataFrame, k: int, percent: int, most: int) -> DataFrame:
    """Links between components (u, v) that share a bucket: ``held`` has key, id, component."""
    mixed_ = held.groupBy("key").agg(
        *[F.expr(x) for x in ("count(1) AS size", "min(component) AS a", "max(component) AS z", "min(id) AS first", "bit_xor(xxhash64(id, 7)) AS x")],
        F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("h"),
    )
    # Buckets of the same members count once.
    mixed_ = mixed_.where("a <> z").groupBy("size", "first", "h", "x").agg(F.min("key").alias("key")).select("key", "size")
    mixed_ = materialize(mixed_, "near-mixed")
    # Sets of sizes m < n can't reach the threshold if m / n is below it: they are in one cell or in neighbouring ones
    # (cells are a little wider than need be, so that rounding does no harm).
    cell = F.when(F.col("size") <= BLOCK, F.lit(0)).otherwise(F.floor(F.log(F.col("n").cast("double")) / math.log(101 / percent)))
    rest = held.join(mixed_, "key").join(reps.select("id", "n", *SKETCH), "id").withColumn("own_cell", cell.cast("long"))
    rest = rest.withColumn("cell", F.explode(F.when(F.col("size") <= BLOCK, F.array("own_cell")).otherwise(F.array("own_cell", F.col("own_cell") + 1))))
    rest = materialize(rest.select("key", "cell", "own_cell", "id", "component", "n", *SKETCH), "near-rest")
    half = max(1, BLOCK // 2)
    groups = rest.groupBy("key", "cell").agg(*[F.expr(x) for x in ("count(1) AS size", "min(component) AS a", "max(component) AS z")]).where("a <> z")
    groups = groups.select("key", "cell", F.expr(f"if(size <= {BLOCK}, 1, (size + {half - 1}) div {half})").alias("blocks"))
    rest = rest.join(materialize(groups, "near-groups"), ["key", "cell"]).withColumn("own", F.pmod(F.xxhash64("id"), "blocks"))
    other = F.explode(F.expr("if(blocks = 1, array(0L), filter(sequence(0L, blocks - 1), x -> x <> own))"))
    block = F.expr("least(own, other) * blocks + greatest(own, other)").alias("block")
    rest = rest.withColumn("other", other).select("key", "cell", block, "id", "component", "n", "own_cell", *SKETCH)
    sketch_sql = ", ".join(f"{s} long" for s in SKETCH)
    # Dealt anew: the join left all blocks of a group in one task.
    rest = rest.repartition(F.col("key"), F.col("cell"), F.col("block"))
    near = rest.groupBy("key", "cell", "block").applyInArrow(
        _candidates(most, percent), f"key long, cell long, block long, id long, component long, {sketch_sql}, pair long",
    )
    near = materialize(near, "near-candidates")
    more = near.join(texts, "id").groupBy("key", "cell", "block", "pair").applyInArrow(_confirm_rest(k, percent, most), "u long, v long")
    return materialize(more, "near-more")


def classes_of(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signed rows, doc_ids whose rows differ, classes of equal sets with their component: d1, d2, n, id, least, component).

    ``least`` is the least doc_id of the class, ``component`` the number of its component.
    """
    most = most_differing_bits(percent / 100)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), "text")
    signed = materialize(rows.mapInArrow(_signed(k), SIGNED), "near-signed")
    known = signed.where("n > 0 and doc_id is not null")
    classes = materialize(known.groupBy(*DIGEST).agg(F.min("row").alias("id"), F.min("doc_id").alias("least")), "near-classes")
    reps = known.join(classes.select(F.col("id").alias("row")), "row").withColumnRenamed("row", "id")
    reps = materialize(reps.select("id", "doc_id", "h", "n", "bands", *SKETCH), "near-reps")
    banded = reps.select("id", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size")).where("size > 1").select("key", "rep")
    members = materialize(banded.join(materialize(buckets, "near-buckets"), "key"), "near-members")
    texts, found = _star_links(docs, reps, members, k, percent, most)
    shared = materialize(_shared(signed), "near-shared")
    if not shared.isEmpty():
        found = found.unionByName(_same_document(known, shared, classes))
    comps = connected_components(found).withColumnRenamed("node", "id")
    held = members.join(comps, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    more = connected_components(_other_links(reps, texts, held, k, percent, most)).select(F.col("node").alias("component"), F.col("component").alias("joined"))
    named = classes.join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))
    return signed, shared, named.join(more, "component", "left").withColumn("component", F.coalesce("joined", "component")).drop("joined")


def _shared(signed: DataFrame) -> DataFrame:
    """doc_ids whose rows differ in their sets."""
    ends = signed.where("doc_id is not null").groupBy("doc_id").agg(*[f(c).alias(f"{name}_{c}") for c in DIGEST for name, f in (("a", F.min), ("z", F.max))])
    return ends.where(" or ".join(f"a_{c} <> z_{c}" for c in DIGEST)).select("doc_id")


def _same_document(known: DataFrame, shared: DataFrame, classes: DataFrame) -> DataFrame:
    """Links u, v between the classes of one doc_id."""
    rows = known.join(shared, "doc_id").join(classes, DIGEST).select("doc_id", F.col("id").alias("u"))
    rows = materialize(rows, "near-shared-rows")
    return rows.join(materialize(rows.groupBy("doc_id").agg(F.min("u").alias("v")), "near-shared-least"), "doc_id").where("u <> v").select("u", "v").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept. Documents are linked if 100 times the common
    shingles are at least ``percent`` times all of the two sets' shingles."""
    with scope() as keep:
        signed, shared, classes = classes_of(docs, k, percent)
        classes = materialize(classes, "near-components")
        tops = materialize(classes.groupBy("component").agg(F.min("least").alias("component_id")), "near-tops")
        of_class = keep(materialize(classes.join(tops, "component").select(*DIGEST, "component_id"), "near-ids"))
        keep(signed), keep(shared)
    rows = signed.where("n > 0 and doc_id is not null").select("doc_id", *DIGEST).join(of_class, DIGEST).select("doc_id", "n", "component_id")
    empty = signed.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    if not shared.isEmpty():  # rows without words take their document's component from its other rows, if it has any
        others = signed.where("n > 0").join(shared, "doc_id", "left_semi").join(of_class, DIGEST).groupBy("doc_id").agg(F.min("component_id").alias("of_others"))
        empty = empty.join(others, "doc_id", "left").select("doc_id", "n", F.coalesce("of_others", "doc_id").alias("component_id"))
    out = rows.unionByName(empty)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
