"""Approximate nearest neighbours: hierarchical navigable small-world graphs per shard.

Rows are dealt to shards by a hash of their id and vector. A shard has a graph for each band of norms (the largest norm
left and those down to half of it), kept as flat neighbour arrays (one matrix per level, -1 for none) in a
row of an index table. Every query searches every shard; the best of all shards are merged. Queries stream
past a shard's graphs, which are loaded once for ``QUERIES`` of them. Inserting and searching go in numpy, for
many points in step.

Largest inner product is turned into nearest by one more coordinate, the square root of what a vector's squared
norm lacks to the largest of its band; vectors are scaled by that norm and queries by their own before they are
rounded to single precision. So neither one vector of huge norm nor huge or tiny components blur the others. A band
whose largest norm can't reach a query's k-th best so far is not searched for it, which loses nothing.
Equal vectors of a graph are one node with a list of ids, so that copies can't crowd a neighbourhood.
Every row is indexed; nothing is sampled.

Scale: a shard holds about ``SHARD_ROOT`` times the square root of all rows, up to ``SHARD_MOST``. So queries that are a
fixed share of n rows search O(sqrt n) shards each, and above 3.3 million rows O(n).

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part,
neither do rows with null id; vectors of another dimension than the query's are not its candidates;
rows that repeat an id are candidates of their own, none of them for a query of that id; query rows that share an
id are one query, that of the fewest components and least vector; ties go to the
smaller id; with fewer candidates than asked for, all are returned; inner products that overflow a double
are infinite, and those that are then undefined are left out; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Rows of a shard: this times the square root of all rows, and the most.
SHARD_ROOT, SHARD_MOST = 36, 65536
#: Links of a node (twice as many at the ground); width of searches while building and querying.
LINKS, BUILD, SEARCH = 16, 64, 256
#: Queries that stream past a shard's graphs in one task.
QUERIES = 16384


@dataclass
class Graph:
    points: np.ndarray  # nodes x dimensions + 1, float32
    level_of: np.ndarray
    order: list[np.ndarray]  # per level: position of a node in the level's matrix, or -1
    links: list[np.ndarray]  # per level: flat neighbour matrix, -1 for none
    entry: int


def _nearness(points: np.ndarray, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Inner products of each query with its own candidates; -inf where the candidate is -1."""
    out = np.einsum("qd,qkd->qk", q, points[np.maximum(ids, 0)], optimize=False)
    out[ids < 0] = -np.inf
    return out


def _beam(g: Graph, level: int, q: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search on one level for all queries in step: the ``width`` nearest found and their
    nearness, nearest first."""
    n = len(q)
    rows = np.arange(n)
    beam = np.full((n, width), -1, np.int32)
    near = np.full((n, width), -np.inf, np.float32)
    beam[:, : start.shape[1]] = start[:, :width]
    near[:, : start.shape[1]] = _nearness(g.points, q, beam[:, : start.shape[1]])
    seen = np.zeros((n, len(g.points) + 1), bool)
    seen[rows[:, None], beam] = True
    done = beam < 0
    at, links = g.order[level], g.links[level]
    live = rows
    while len(live):
        open_near = np.where(done[live], -np.inf, near[live])
        best = open_near.argmax(axis=1)
        go = open_near[np.arange(len(live)), best] > -np.inf
        live, best = live[go], best[go]
        if not len(live):
            break
        done[live, best] = True
        nodes = beam[live, best]
        around = links[at[nodes]]
        around = np.where(seen[live[:, None], around], -1, around)
        seen[live[:, None], around] = True
        far = _nearness(g.points, q[live], around)
        ids = np.concatenate([beam[live], around], axis=1)
        score = np.concatenate([near[live], far], axis=1)
        flag = np.concatenate([done[live], around < 0], axis=1)
        pick = np.argpartition(-score, width - 1, axis=1)[:, :width]
        beam[live], near[live], done[live] = (np.take_along_axis(x, pick, 1) for x in (ids, score, flag))
    order = np.argsort(-near, axis=1, kind="stable")
    return np.take_along_axis(beam, order, 1), np.take_along_axis(near, order, 1)


def _spread(points: np.ndarray, ids: np.ndarray, near: np.ndarray, links: int) -> np.ndarray:
    """Up to ``links`` neighbours from candidates (nearest first): one is taken if it is nearer to the point
    than to any taken before; the nearest of the rest fill up."""
    n, k = ids.shape
    norms = (points * points).sum(axis=1)
    out = np.full((n, links), -1, np.int32)
    count = np.zeros(n, np.int64)
    chosen = np.zeros((n, k), bool)
    worst = np.full((n, k), np.inf, np.float32)  # squared distance to the nearest taken
    vectors = points[np.maximum(ids, 0)]
    own = norms[np.maximum(ids, 0)]
    gap = own - 2 * near  # squared distance to the point, less the point's norm, which all have alike
    rows = np.arange(n)
    base = norms.max()  # points on one sphere: all norms are alike
    for c in range(k):
        ok = (ids[:, c] >= 0) & (count < links) & (gap[:, c] + base < worst[:, c])
        r = rows[ok]
        if not len(r):
            continue
        out[r, count[r]] = ids[r, c]
        count[r] += 1
        chosen[r, c] = True
        d = own[r] + own[r, c][:, None] - 2 * np.einsum("nkd,nd->nk", vectors[r], vectors[r, c], optimize=False)
        worst[r] = np.minimum(worst[r], d)
    for c in range(k):
        ok = (ids[:, c] >= 0) & (count < links) & ~chosen[:, c]
        r = rows[ok]
        out[r, count[r]] = ids[r, c]
        count[r] += 1
    return out


def _attach(g: Graph, level: int, new: np.ndarray, chosen: np.ndarray) -> None:
    """Set the new nodes' links and add the reverse ones; full nodes choose anew."""
    at, links = g.order[level], g.links[level]
    width = links.shape[1]
    links[at[new], : chosen.shape[1]] = chosen
    source = np.repeat(new, chosen.shape[1])
    target = chosen.ravel()
    source, target = source[target >= 0], target[target >= 0]
    known = (links[at[target]] == source[:, None]).any(axis=1)  # both of a batch may have chosen each other
    source, target = source[~known], target[~known]
    by = np.argsort(target, kind="stable")
    source, target = source[by], target[by]
    nodes, first, extra = np.unique(target, return_index=True, return_counts=True)
    have = (links[at[nodes]] >= 0).sum(axis=1)
    fits = have + extra <= width
    slot = np.arange(len(target)) - np.repeat(first, extra) + np.repeat(have, extra)
    easy = np.repeat(fits, extra)
    links[at[target[easy]], slot[easy]] = source[easy]
    full = np.flatnonzero(~fits)
    for a in range(0, len(full), 512):
        some = full[a : a + 512]
        wide = np.full((len(some), width + int(extra[some].max())), -1, np.int32)
        wide[:, :width] = links[at[nodes[some]]]
        for i, x in enumerate(some):
            wide[i, width : width + extra[x]] = source[first[x] : first[x] + extra[x]]
        near = _nearness(g.points, g.points[nodes[some]], wide)
        order = np.argsort(-near, axis=1, kind="stable")
        links[at[nodes[some]]] = _spread(g.points, np.take_along_axis(wide, order, 1), np.take_along_axis(near, order, 1), width)


def build(vectors: np.ndarray, seed: int = 1) -> Graph:
    """Graph over distinct vectors of norms up to 1. Points are inserted in batches that grow with the graph; a batch's points
    see the graph so far and each other."""
    n = len(vectors)
    norms = (vectors**2).sum(axis=1)
    lift = np.sqrt(np.maximum(0, 1 - norms))
    points = np.concatenate([vectors, lift[:, None]], axis=1).astype(np.float32)
    rng = np.random.default_rng(seed)
    level_of = np.minimum(8, (-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(int))
    order, links = [], []
    for level in range(int(level_of.max(initial=0)) + 1):
        here = np.flatnonzero(level_of >= level)
        at = np.full(n, -1, np.int32)
        at[here] = np.arange(len(here))
        order.append(at)
        links.append(np.full((len(here), LINKS * (2 if level == 0 else 1)), -1, np.int32))
    g = Graph(points, level_of, order, links, 0)
    insert = np.argsort(-level_of, kind="stable")  # upper levels first
    g.entry = int(insert[0]) if n else -1
    done = 1
    while done < n:
        size = max(1, min(512, done // 4))
        for top in range(int(level_of[insert[done]]), -1, -1):  # a batch has one level
            same = insert[done : done + size]
            same = same[level_of[same] == top]
            if len(same):
                break
        q = points[same]
        start = np.full((len(same), 1), g.entry, np.int32)
        for level in range(len(links) - 1, -1, -1):
            wide = BUILD if level <= top else 1
            ids, near = _beam(g, level, q, start, wide)
            if level <= top:
                inner = q @ q.T
                np.fill_diagonal(inner, -np.inf)
                k = min(LINKS, len(same) - 1)
                mates = np.argpartition(-inner, k - 1, axis=1)[:, :k] if k else np.zeros((len(same), 0), np.int64)
                close, mates = np.take_along_axis(inner, mates, 1), same[mates].astype(np.int32)
                again = (ids[:, :, None] == mates[:, None, :]).any(axis=1)  # met on the level above
                ids = np.concatenate([ids, np.where(again, -1, mates)], axis=1)
                near = np.concatenate([near, np.where(again, -np.inf, close)], axis=1)
                by = np.argsort(-near, axis=1, kind="stable")
                ids, near = np.take_along_axis(ids, by, 1), np.take_along_axis(near, by, 1)
                _attach(g, level, same, _spread(points, ids, near, LINKS))
            start = ids[:, : max(1, min(8, ids.shape[1]))]
        done += len(same)
    return g


def search(g: Graph, queries: np.ndarray, width: int) -> np.ndarray:
    """Node numbers of the ``width`` nearest found for each query (-1: none)."""
    q = np.concatenate([queries, np.zeros((len(queries), 1), np.float32)], axis=1).astype(np.float32)
    out = np.empty((len(q), width), np.int32)
    step = max(1, min(256, (1 << 24) // max(1, len(g.points))))
    for a in range(0, len(q), step):
        part = q[a : a + step]
        start = np.full((len(part), 1), g.entry, np.int32)
        for level in range(len(g.links) - 1, 0, -1):
            start = _beam(g, level, part, start, 1)[0]
        out[a : a + step] = _beam(g, 0, part, start, width)[0]
    return out


def _vectors(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def norms_of(vectors: np.ndarray) -> np.ndarray:
    """Euclidean norms, without overflow."""
    most = np.abs(vectors).max(axis=1, initial=0)
    return most * np.sqrt(((vectors / np.where(most > 0, most, 1)[:, None]) ** 2).sum(axis=1))


def bands_of(norms: np.ndarray) -> list[np.ndarray]:
    """Rows by bands of norms, from the largest: the largest left and all down to half of it."""
    order = np.argsort(-norms, kind="stable")
    falling, out, first = -norms[order], [], 0
    while first < len(order):
        last = int(np.searchsorted(falling, falling[first] / 2, "right"))
        out.append(order[first:last])
        first = last
    return out


def _index(table: pa.Table) -> pa.Table:
    """One shard's rows (dim, shard, id, vec) to a row of flat arrays for each band of norms."""
    dim, shard = table.column("dim")[0].as_py(), table.column("shard")[0].as_py()
    by = np.argsort(table.column("id").to_numpy(), kind="stable")
    all_ids, all_vectors = table.column("id").to_numpy()[by], _vectors(table.column("vec"), dim)[by]
    norms = norms_of(all_vectors)
    rows = []
    for band, own in enumerate(bands_of(norms)):
        own = np.sort(own)
        ids, top = all_ids[own], float(norms[own].max())
        distinct, node = np.unique(all_vectors[own], axis=0, return_inverse=True)
        node = node.ravel()
        members = np.argsort(node, kind="stable")
        first = np.concatenate([[0], np.cumsum(np.bincount(node, minlength=len(distinct)))])
        g = build(distinct / top)
        arrays = {"vectors": distinct, "ids": ids[members].astype(np.int64), "first": first.astype(np.int64), "points": g.points}
        row = {"dim": dim, "shard": shard, "band": band, "top": top, "entry": g.entry}
        rows.append(row | {k: v.tobytes() for k, v in arrays.items()} | {k: [x.tobytes() for x in v] for k, v in (("levels", g.order), ("links", g.links))})
    return pa.Table.from_pylist(rows, INDEX)


_BYTES, _LISTS = ("vectors", "ids", "first", "points"), ("levels", "links")
INDEX = pa.schema(
    [("dim", pa.int32()), ("shard", pa.int64()), ("band", pa.int32()), ("top", pa.float64()), ("entry", pa.int64())]
    + [(c, pa.binary()) for c in _BYTES]
    + [(c, pa.list_(pa.binary())) for c in _LISTS]
)
INDEX_SQL = "dim int, shard long, band int, top double, entry long, " + ", ".join([f"{c} binary" for c in _BYTES] + [f"{c} array<binary>" for c in _LISTS])


@dataclass
class Loaded:
    """A graph of the index table with the original vectors."""

    graph: Graph
    top: float
    vectors: np.ndarray
    ids: np.ndarray
    first: np.ndarray


def _load(row: dict) -> Loaded:
    dim = row["dim"]
    points = np.frombuffer(row["points"], np.float32).reshape(-1, dim + 1)
    order = [np.frombuffer(x, np.int32) for x in row["levels"]]
    links = [np.frombuffer(x, np.int32).reshape(-1, LINKS * (2 if i == 0 else 1)) for i, x in enumerate(row["links"])]
    graph = Graph(points, np.zeros(0, int), order, links, row["entry"])
    return Loaded(
        graph, row["top"], np.frombuffer(row["vectors"], np.float64).reshape(-1, dim), np.frombuffer(row["ids"], np.int64), np.frombuffer(row["first"], np.int64),
    )


def inner_products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Double-precision inner products of each query with its own vectors, summed in the order of
    components, so equal vectors score alike."""
    out = np.zeros(vectors.shape[:2])
    for d in range(queries.shape[1]):
        out += queries[:, d, None] * vectors[:, :, d]
    return out


def best_of(own: int, found: np.ndarray, score: np.ndarray, part: Loaded, k: int) -> list[tuple[float, int]]:
    """The ``k`` best (score, id) of one query's nodes, its own id left out; ids of one score share a pool, the smaller first."""
    rows: list[tuple[float, int]] = []
    level, pool = None, []
    for j in np.argsort(-score, kind="stable"):
        if score[j] == -np.inf:
            break
        if score[j] != level:
            rows += [(level, x) for x in sorted(pool)[:k]]
            level, pool = score[j], []
            if len(rows) >= k:
                break
        some = part.ids[part.first[found[j]] : part.first[found[j] + 1]]
        pool += some[some != own][:k].tolist()
    return rows + [(level, x) for x in sorted(pool)[:k]]


def search_bands(bands: list[Loaded], q_ids: np.ndarray, q: np.ndarray, k: int, width: int) -> list[list[tuple[float, int]]]:
    """For each query the best rows of one shard's bands: (score, id), at least ``k`` of them if there are."""
    best: list[list[tuple[float, int]]] = [[] for _ in q_ids]
    size = norms_of(q)
    unit = (q / size[:, None]).astype(np.float32)
    least = np.full(len(q), -np.inf)  # the k-th best so far
    for part in bands:
        with np.errstate(over="ignore", invalid="ignore"):
            live = np.flatnonzero(~(size * part.top * (1 + 1e-9) < least))
            if not len(live):
                continue
            found = search(part.graph, unit[live], min(max(width, k + 1), len(part.vectors)))
            score = inner_products(q[live], part.vectors[np.maximum(found, 0)])
        score[(found < 0) | np.isnan(score)] = -np.inf
        for i, nodes, own in zip(live, found, score, strict=True):
            more = best_of(q_ids[i], nodes, own, part, k)
            best[i] = sorted(best[i] + more, key=lambda x: (-x[0], x[1]))[:k] if best[i] else more
            if len(best[i]) >= k:
                least[i] = best[i][k - 1][0]
    return best


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _search(k: int, width: int):
    """Rows sorted by (dim, shard, split), graphs before queries, the largest norms first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bands = None, []
        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in ("dim", "shard", "split")], strict=True))
            graph = batch.column("id").is_null().to_numpy(zero_copy_only=False)
            i = 0
            while i < len(keys):
                if graph[i]:
                    if keys[i] != at:
                        at, bands = keys[i], []
                    bands.append(_load({c: batch.column(c)[i].as_py() for c in INDEX.names}))
                    i += 1
                    continue
                j = i
                while j < len(keys) and not graph[j] and keys[j] == keys[i] and j - i < 1024:
                    j += 1
                q_ids, q = batch.column("id")[i:j].to_numpy(), _vectors(batch.column("vec")[i:j], keys[i][0])
                best = search_bands(bands if keys[i] == at else [], q_ids, q, k, width)
                count = [len(b) for b in best]
                columns = [np.repeat(q_ids, count), [x for b in best for _, x in b], [x for b in best for x, _ in b]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FOUND, strict=True)], schema=FOUND)
                i = j

    return run


def clean(vectors: DataFrame) -> DataFrame:
    """(dim, id, vec as doubles) of the rows that take part."""
    vec = F.col("embedding").cast("array<double>")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine).select(
        F.size(vec).alias("dim"), F.col("vec_id").cast("long").alias("id"), vec.alias("vec"),
    )


def build_index(rows: DataFrame, shard_root: int = SHARD_ROOT, shard_most: int = SHARD_MOST) -> DataFrame:
    """The index table of cleaned rows: graphs by (dim, shard, band)."""
    counts = rows.groupBy("dim").count().collect()  # one row per dimension
    shards = F.lit(1).cast("long")
    for r in counts:
        shards = F.when(F.col("dim") == r["dim"], F.lit(-(-r["count"] // min(shard_most, shard_root * math.isqrt(r["count"])))).cast("long")).otherwise(shards)
    dealt = rows.select("dim", F.pmod(F.xxhash64("id", "vec"), shards).alias("shard"), "id", "vec")
    return materialize(dealt.groupBy("dim", "shard").applyInArrow(_index, INDEX_SQL), "ann-index")


def nearest(queries: DataFrame, index: DataFrame, k: int = 20, width: int = SEARCH) -> DataFrame:
    """Per query (dim, id, vec): its ``k`` nearest rows of the index by inner product: query_id, rank,
    vec_id, score."""
    queries = queries.groupBy("id").agg(F.min(F.struct("dim", "vec")).alias("q")).select("q.dim", "id", "q.vec")
    queries = materialize(queries, "ann-queries")
    splits = max(1, -(-queries.count() // QUERIES))
    asked = queries.withColumn("split", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(splits)))
    last = F.lit(None).cast("long")
    for r in index.groupBy("dim").agg(F.max("shard").alias("shard")).collect():  # one row per dimension
        last = F.when(F.col("dim") == r["dim"], F.lit(r["shard"]).cast("long")).otherwise(last)
    asked = asked.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("shard"))
    graphs = index.select("*", F.explode(F.expr(f"sequence(0L, {splits - 1}L)")).alias("split"))
    rows = graphs.unionByName(asked, allowMissingColumns=True)
    keys = ["dim", "shard", "split"]
    dealt = rows.repartition(*[F.col(c) for c in keys]).sortWithinPartitions(*keys, F.col("id").isNotNull(), "band")
    found = dealt.mapInArrow(_search(k, width), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_table(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """Search ``vectors`` (vec_id, embedding) with each row whose id is divisible by ``every``."""
    rows = clean(vectors)
    return nearest(rows.where(F.col("id") % every == 0), build_index(rows), k)
