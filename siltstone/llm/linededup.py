"""Line deduplication by pairwise alignment.

Runs of consecutive lines that together reach ``BLOCK_WORDS`` words, the shortest from and up to each line, are
hashed. Each such run that several documents hold proposes one partner to every later holder: the first
document that holds it (least doc_id). So a run held by very many documents proposes as many pairs as it has
holders, never all pairs, and common runs need not be left out for the sake of rare ones: a bound on how many
documents may hold a line would drop cases. Words of scripts without spaces count by characters. As a pair loses
every run that both hold, in whatever order, other partners could add nothing: exactly the lines go that stand in
a run of that many words which any earlier document holds.
Each pair is aligned by patience diff on line hashes: lines unique in both, their longest rising
sequence, then the gaps between them and equal lines at their ends. Aligned runs of at least
``BLOCK_WORDS`` words are deleted from the later document. One rising order leaves out repeats and blocks
in another order, so what is left is held against the partner again, wherever it stands: every run of the later
document of that many words which the partner holds goes, each time it occurs.
Lines count as equal if two independent 64-bit hashes of their bytes are.

Defined cases: null text stays null; a text whose lines are all deleted becomes empty; rows that share
doc_id are ordered by a hash of their text, and exact repeats of a row count as one document
(each keeps or loses the same lines); null doc_id comes last; a very long text is hashed by pieces, and its
line hashes must fit in a task; lines of any length count, short ones by the runs that they form; an empty table
gives an empty result; further columns of ``docs`` are kept as they are, whatever their names.

Scale: what is shuffled beside the texts' own join are line hashes. A first holder's hashes go once to each ``CHUNK``
of its partners, which stream past it, so no task gathers the holders of a run.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, scope
from .textbytes import buffers, line_spans, slices, span_hashes

BLOCK_WORDS = 8
#: Partners of a first holder that one task aligns.
CHUNK = 512
_NULL_ID = 2**63 - 1


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs (sorted by the first) that rises in the second (patience sorting)."""
    tops, at, back = [], [], [-1] * len(pairs)
    for i, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        if pile == len(tops):
            tops.append(j)
            at.append(i)
        else:
            tops[pile], at[pile] = j, i
        back[i] = at[pile - 1] if pile else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned line numbers of two documents, rising in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {b[j]: j for j in range(b0, b1) if in_b[b[j]] == 1}
        anchors = _rising([(i, where[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and a[i] in where])
        if anchors:
            i0, j0 = a0, b0
            for i, j in anchors:
                todo.append((i0, i, j0, j))
                out.append((i, j))
                i0, j0 = i + 1, j + 1
            todo.append((i0, a1, j0, b1))
    return sorted(out)


def windows(lines: np.ndarray, words: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the shortest runs of at least ``least`` words from each line and up to each line of
    the texts whose first lines are ``first`` (n + 1 offsets). Those inside a longer run cover all of it."""
    sums = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    own = np.diff(first)
    at = np.arange(len(lines))
    e = np.searchsorted(sums, sums[:-1] + least, "left")
    s = np.searchsorted(sums, sums[1:] - least, "right") - 1
    forward = e <= np.repeat(first[1:], own)
    backward = s >= np.repeat(first[:-1], own)
    backward[backward] = e[s[backward]] != at[backward] + 1  # else it is that line's own already
    s, e = np.concatenate([at[forward], s[backward]]), np.concatenate([e[forward], at[backward] + 1])
    return s, e, span_hashes(lines, s, e)


def held_lines(a: list[int], b: list[int], words: list[int], least: int) -> list[int]:
    """Lines of ``b`` in any run of at least ``least`` words that ``a`` holds too."""
    known = dict(zip(b, words, strict=True))
    words_a = [known.get(x, least) for x in a]  # a run with a line that only ``a`` holds is none of ``b``'s
    (_, _, in_a), (s, e, in_b) = (windows(np.array(x, np.int64).view(np.uint64), np.array(w, np.int64), np.array([0, len(x)]), least) for x, w in ((a, words_a), (b, words)))
    both = np.isin(in_b, in_a)
    steps = np.bincount(s[both], minlength=len(b) + 1) - np.bincount(e[both], minlength=len(b) + 1)
    return np.flatnonzero(np.cumsum(steps)[:-1]).tolist()


def common_lines(a: list[int], b: list[int], words: list[int], least: int) -> list[int]:
    """Lines of ``b`` in runs of at least ``least`` words that ``a`` holds: aligned ones, then all others."""
    out, run = [], []
    for i, j in [*patience(a, b), (-9, -9)]:
        if run and (i, j) != (run[-1][0] + 1, run[-1][1] + 1):
            if sum(words[y] for _, y in run) >= least:
                out += [y for _, y in run]
            run = []
        run.append((i, j))
    in_a, gone = set(a), set(out)
    if any(x in in_a for j, x in enumerate(b) if j not in gone):
        out = held_lines(a, b, words, least)
    return out


def _runs(lines: np.ndarray, words: np.ndarray, first: np.ndarray, least: int) -> pa.ListArray:
    """Each text's distinct hashes of runs of lines."""
    s, _, keys = windows(lines, words, first, least)
    text = np.searchsorted(first, s, "right") - 1
    order = np.lexsort([keys, text])
    keys, text = keys[order], text[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
    at = np.searchsorted(text[new], np.arange(len(first)))
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(keys[new].view(np.int64)))


LINES = "id long, h long, lines array<long>, marks array<long>, words array<int>"


def _lines(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        for a, b in slices(offsets):
            hashes, marks, words, first = line_spans(data, offsets[a : b + 1])
            at = pa.array(first.astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (hashes.view(np.int64), marks.view(np.int64), words.astype(np.int32))]
            runs = _runs(hashes, words, first, least)
            yield pa.RecordBatch.from_arrays([batch.column("id")[a:b], batch.column("h")[a:b], *lists, runs], names=["id", "h", "lines", "marks", "words", "runs"])


def numbers(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Rows of two tables of hashes as numbers that are equal where the rows are."""
    both = np.concatenate([a, b])
    order = np.lexsort(both.T)
    new = np.zeros(len(both), np.int64)
    new[1:] = (both[order[1:]] != both[order[:-1]]).any(axis=1)
    out = np.empty(len(both), np.int64)
    out[order] = np.cumsum(new)
    return out[: len(a)].tolist(), out[len(a) :].tolist()


def _align(least: int):
    """Rows sorted by (fid, fh, chunk), the first holder's own before its partners': partners' lines to delete."""
    names = ["id", "h", "cut"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, np.zeros((0, 2), np.int64)
        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in ("fid", "fh", "chunk")], strict=True))
            partner = batch.column("partner").to_pylist()
            rows, cut = [], []
            for i, key in enumerate(keys):  # one document's lists at a time
                lines, marks = (batch.column(c)[i].values.to_numpy() for c in ("lines", "marks"))
                hashes = np.stack([lines, marks], axis=1)
                if not partner[i]:
                    at, own = key, hashes
                    continue
                if key != at:
                    raise AssertionError("a first holder comes before its partners")
                if np.array_equal(own, hashes):
                    gone = np.arange(len(hashes))
                else:
                    gone = common_lines(*numbers(own, hashes), batch.column("words")[i].values.to_pylist(), least)
                rows.append(i)
                cut.append(pa.array(gone, pa.int32()))
            ends = np.cumsum([0, *map(len, cut)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays(cut) if cut else pa.array([], pa.int32()))
            pick = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pick), batch.column("h").take(pick), lists], names=names)

    return run


def cuts(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id, h, cut): the numbers of the lines to delete, for documents (doc_id, text) that lose any."""
    with scope() as keep:
        keyed = docs.where("text is not null").select(_id().alias("id"), F.xxhash64("text").alias("h"), "text")
        lines = keyed.mapInArrow(lambda batches: _lines(batches, block_words), LINES + ", runs array<long>").dropDuplicates(["id", "h"])
        lines = materialize(lines, "lines")
        held = lines.select("id", "h", F.explode("runs").alias("run"))
        first = held.groupBy("run").agg(F.min(F.struct("id", "h")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("run", "first")
        first = materialize(first, "line-first")  # a plain join side, so that Spark can split a hot run's rows
        pairs = held.join(first, "run").where(F.struct("id", "h") != F.col("first")).select("id", "h", F.col("first.id").alias("fid"), F.col("first.h").alias("fh")).distinct()
        pairs = materialize(pairs, "line-pairs")
        chunks = pairs.groupBy("fid", "fh").agg(F.expr(f"(count(1) + {CHUNK - 1}) div {CHUNK}").alias("chunks"))
        chunks = materialize(chunks, "line-chunks")  # likewise for a hot first holder's
        of_chunk = ["fid", "fh", "chunk"]
        partners = pairs.join(chunks, ["fid", "fh"]).select("id", "h", "fid", "fh", F.expr("pmod(xxhash64(id, h), chunks)").alias("chunk"), F.lit(True).alias("partner"))
        heads = chunks.select(F.col("fid").alias("id"), F.col("fh").alias("h"), "fid", "fh", F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk"), F.lit(False).alias("partner"))
        both = partners.unionByName(heads).join(lines.drop("runs"), ["id", "h"])
        dealt = both.repartition(*[F.col(c) for c in of_chunk]).sortWithinPartitions(*of_chunk, "partner")
        cut = dealt.mapInArrow(_align(block_words), "id long, h long, cut array<int>")
        cut = cut.where(F.size("cut") > 0).groupBy("id", "h").agg(F.array_distinct(F.flatten(F.collect_list("cut"))).alias("cut"))
        return keep(materialize(cut, "line-cuts"))


def _id(doc_id="doc_id"):
    return F.coalesce(F.col(doc_id).cast("long") if isinstance(doc_id, str) else doc_id.cast("long"), F.lit(_NULL_ID))


def _delete(at: int):
    """Rows whose last column is the list of lines to delete from column ``at``: the other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = batch.column(batch.num_columns - 1)
            texts = batch.column(at)
            some = np.flatnonzero(cut.is_valid().to_numpy(zero_copy_only=False))
            if len(some):
                texts = texts.to_pylist()
                for i in some:
                    gone = set(cut[i].as_py())
                    texts[i] = "\n".join(x for j, x in enumerate(texts[i].split("\n")) if j not in gone)
                texts = pa.array(texts, batch.schema.field(at).type)
            columns = [texts if i == at else batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(batch.schema)[:-1]))

    return run


def deduped(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One column ``doc``, a struct of the columns of ``docs`` with common blocks deleted from the text, and the
    numbers ``lines`` (before) and ``removed``. So no column of ``docs`` can clash with others."""
    cut = cuts(docs, block_words).select(F.col("id").alias("cut_id"), F.col("h").alias("cut_h"), "cut")
    own = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # by position
    at = docs.columns.index("text")
    text, doc_id = F.col(f"c{at}"), F.col(f"c{docs.columns.index('doc_id')}")
    keyed = own.withColumns({"own_id": _id(doc_id), "own_h": F.xxhash64(text)})
    joined = keyed.join(cut, (F.col("own_id") == F.col("cut_id")) & (F.col("own_h") == F.col("cut_h")), "left")
    lines = F.coalesce(F.length(text) - F.length(F.translate(text, "\n", "")) + 1, F.lit(0)).cast("long")
    removed = F.when(F.col("cut").isNull(), 0).otherwise(F.size("cut")).cast("long")
    wide = joined.select(*own.columns, lines.alias("lines"), removed.alias("removed"), "cut")
    out = wide.mapInArrow(_delete(at), T.StructType(wide.schema.fields[:-1]))
    return out.select(F.struct(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]).alias("doc"), "lines", "removed")


def dedup_lines(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows of ``docs`` with common blocks deleted, and two more columns: __lines (lines before) and __removed
    (lines deleted), which replace columns of those names."""
    out = deduped(docs, block_words)
    kept = [F.col("doc").getField(c).alias(c) for c in docs.columns if c not in ("__lines", "__removed")]
    return out.select(*kept, F.col("lines").alias("__lines"), F.col("removed").alias("__removed"))
