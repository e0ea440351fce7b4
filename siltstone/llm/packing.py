"""Packing by optimal length buckets.

The global histogram of lengths is gathered, a row for each length that occurs. As d different lengths take at
least d (d - 1) / 2 tokens, it grows with the square root of the tokens at most. Dynamic programming over it finds the
bucket boundaries that minimise padding, and batches of at most ``budget`` tokens, padding included, form in
each bucket. A document longer than the budget is a batch of its own; nothing is cut or dropped.

Defined cases: null and empty texts have length 0 and go to the first bucket; repeated rows and equal or
null ids are documents of their own; a very long text is a batch of its own; an empty table gives an empty result;
other columns are ignored unless named in ``keep``. Rows are numbered by salted offsets, so a bucket holding a third
of all rows meets in no single task.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, numbered, word_count

def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets that minimise the padding, by dynamic programming.

    ``lengths`` rise; the last bound is the last length. In whole numbers, so exact. A bucket of lengths i+1 to j costs
    the length j for each row. For a given j the best i is where the least of the lines cost(i) - length * rows(i) stands
    at length j. As their slopes fall with i and lengths rise, each layer takes one pass over the lower hull of the lines.
    """
    n = len(lengths)
    if n <= buckets:
        return list(lengths)
    rows = [0, *accumulate(counts)]
    best, cut = [x * r for x, r in zip(lengths, rows[1:], strict=True)], []
    for _ in range(buckets - 1):
        new, split, hull, at = best.copy(), [-1] * n, [], 0
        for j in range(1, n):
            i = j - 1
            while len(hull) - at > 1 and _above(best, rows, hull[-2], hull[-1], i):
                hull.pop()
            hull.append(i)
            x = lengths[j]
            while len(hull) - at > 1 and best[hull[at + 1]] - x * rows[hull[at + 1] + 1] < best[hull[at]] - x * rows[hull[at] + 1]:
                at += 1
            cost = best[hull[at]] + x * (rows[j + 1] - rows[hull[at] + 1])
            if cost < new[j]:
                new[j], split[j] = cost, hull[at]
        best = new
        cut.append(split)
    out, j = [], n - 1
    for split in reversed(cut):
        out.append(lengths[j])
        if split[j] < 0:
            break
        j = split[j]
    else:
        out.append(lengths[j])
    return sorted(set(out))


def _above(best: list[int], rows: list[int], a: int, b: int, c: int) -> bool:
    """Whether line b is nowhere below both a and c (slopes fall from a to c)."""
    return (best[c] - best[a]) * (rows[b + 1] - rows[a + 1]) <= (best[b] - best[a]) * (rows[c + 1] - rows[a + 1])


def pack(docs: DataFrame, buckets: int = 16, budget: int = 16384, keep: tuple[str, ...] = (), seed: int = 29) -> DataFrame:
    """Per document: doc_id, n_tokens, bucket, bucket_len, batch, slot, padding and the kept columns.

    Tokens are words. ``batch`` counts from 0 in each bucket; a batch holds budget div bucket_len
    documents (at least 1), in the pseudorandom order of a hash.
    """
    salt = F.xxhash64(F.lit(seed), "doc_id", "text")
    sized = docs.select("doc_id", word_count(F.col("text")).alias("n_tokens"), salt.alias("__salt"), *keep)
    sized = materialize(sized, "pack-lengths")
    histogram = sized.groupBy("n_tokens").count().orderBy("n_tokens").toArrow()
    lengths, counts = histogram.column("n_tokens").to_pylist(), histogram.column("count").to_pylist()
    bounds = boundaries(lengths, counts, buckets) or [0]
    bound = F.array(*[F.lit(b).cast("long") for b in bounds])
    sized = sized.withColumn("bucket", F.size(F.filter(bound, lambda b: b < F.col("n_tokens"))))
    sized = numbered(sized.withColumn("h", F.col("__salt")), ["bucket"], [F.col("h"), F.col("doc_id")], sum(counts), "at")
    length = F.get(bound, F.col("bucket"))
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(length, F.lit(1)))).cast("long")
    out = sized.withColumn("bucket_len", length).withColumn("room", room)
    return out.select(
        "doc_id",
        "n_tokens",
        "bucket",
        "bucket_len",
        F.expr("at div room").alias("batch"),
        F.expr("at % room").alias("slot"),
        (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
        *keep,
    )
