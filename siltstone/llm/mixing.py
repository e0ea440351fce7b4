"""Mixing sources to target weights, with DataFrame operations only.

Each source's documents form one stream of words, cut into blocks of ``block_words``. Each output
shard of ``shard_slots`` slots draws multinomial counts over the sources. The slots of a source are
numbered across shards; slot j belongs to epoch j div n and maps to a block by a pseudorandom
permutation of that source's n block numbers (swap-or-not, exact for every n); blocks are joined by
(source, number). Draws beyond a source's quota are void, and missing ones go to settling shards, so
each source gives its target to the word; the last slot of a source is cut to the words still due.

Defined cases: null text counts 0 words and is never taken; null source is a source of its own, last;
repeated rows and rows with equal or null doc_id are documents of their own (order in the stream: by
hash bucket, doc_id, size, hash of the row); a very long text is split into words once, which must fit in a task;
an empty table gives an empty mix; other columns are ignored, whatever their names.

Scale: only (doc_id, source, size) is shuffled, salted by hash bucket, so no source meets in one task; texts of
mixed documents are shuffled once, by the documents' numbers. Windows without salt see one row per source, per
(source, bucket) or per (source, shard) only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, root_buckets, word_count

#: Rounds of the permutation.
ROUNDS = 24


@dataclass
class Mix:
    sources: DataFrame  # src, rank, source_size, target, words, blocks, ...
    documents: DataFrame  # rank, bucket, rn, doc_id, size, start, source_size, target
    taken: DataFrame  # documents' segments with the slots that take them (left join)


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """Add rank, weight and target to one row per source (src, source_size).

    Water filling in closed form: by rising cap per weight, a source is capped while that is no more
    than the level left for it and all later ones; the highest level holds for the others.
    """
    w = F.array(*[F.lit(float(x)) for x in weights])
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("src").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.get(w, F.col("rank") % len(weights)))
    by_level = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    to_end = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(Window.partitionBy()) - cap * F.coalesce(F.sum("source_size").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = left / F.sum("weight").over(to_end)
    leveled = ranked.withColumn("level", level)
    top = F.max("level").over(Window.partitionBy())
    return leveled.withColumn("target", F.least(cap * F.col("source_size"), top * F.col("weight"))).drop("level")


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """Pseudorandom permutation of 0..n-1 (swap-or-not shuffle), keyed by ``key``."""

    def step(at: Column, r: Column) -> Column:
        other = F.pmod(F.xxhash64(*key, r) - at, n)
        return F.when(F.xxhash64(*key, r + ROUNDS, F.greatest(at, other)) % 2 == 0, at).otherwise(other)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), x.cast("long"), step)


def draws(sources: DataFrame, slots: int, shard_slots: int, seed: int) -> DataFrame:
    """Multinomial counts by shard: (shard, rank, n). Each slot draws one number below ``slots``;
    a cell table of bounded overlap finds the source whose quota range holds it."""
    spark = sources.sparkSession
    width = max(1, -(-slots // 4096))
    ranges = sources.where("quota > 0").select("rank", "quota", "quota_from")
    cells = ranges.select("rank", F.col("quota_from").alias("lo"), (F.col("quota_from") + F.col("quota")).alias("hi"))
    cells = cells.select("*", F.explode(F.expr(f"sequence(lo div {width}, (hi - 1) div {width})")).alias("cell"))
    drawn = spark.range(slots).select((F.col("id") / shard_slots).cast("long").alias("shard"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(slots)).alias("v"))
    drawn = drawn.withColumn("cell", F.expr(f"v div {width}"))
    hit = drawn.join(cells, (drawn.cell == cells.cell) & (F.col("v") >= F.col("lo")) & (F.col("v") < F.col("hi")))
    return hit.groupBy("shard", "rank").agg(F.count(F.lit(1)).alias("n"))


def slots_of(sources: DataFrame, slots: int, block_words: int, shard_slots: int, seed: int) -> DataFrame:
    """All slots of the mix: shard, rank, slot, block, words (how many of the block's first words)."""
    counts = draws(sources, slots, shard_slots, seed)
    before = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("from", F.coalesce(F.sum("n").over(before), F.lit(0)))
    facts = ["rank", "quota", "source_size", "words", "full", "blocks"]
    drawn = counts.join(sources.select(*facts), "rank").withColumn("to", F.least(F.col("from") + F.col("n"), F.col("quota"))).where("from < to")
    drawn = drawn.select("shard", *facts, "from", "to")
    got = counts.groupBy("rank").agg(F.sum("n").alias("got"))
    due = sources.join(got, "rank", "left").select(*facts, F.coalesce("got", F.lit(0)).alias("from"), F.col("quota").alias("to")).where("from < to")
    gap_before = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)  # one row per source
    due = due.withColumn("gap", F.coalesce(F.sum(F.col("to") - F.col("from")).over(gap_before), F.lit(0)))
    due = due.select("*", F.explode(F.expr(f"sequence(from, to - 1, {shard_slots})")).alias("at"))
    last = -(-slots // shard_slots)
    due = due.select(
        (F.lit(last) + F.expr(f"(gap + at - from) div {shard_slots}")).alias("shard"),
        *facts,
        F.col("at").alias("from"),
        F.least(F.col("at") + shard_slots, F.col("to")).alias("to"),
    )
    spread = max(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-slots // 65536))
    runs = drawn.unionByName(due).repartition(spread, "rank", "shard")
    each = runs.select("shard", *facts, F.explode(F.sequence(F.col("from"), F.col("to") - 1)).alias("slot"))
    each = each.select("*", F.expr("slot div blocks").alias("epoch"), F.expr("slot % blocks").alias("p"))
    block = F.when(F.col("p") < F.col("full"), permuted(F.col("p"), F.greatest("full", F.lit(1)), F.lit(seed), F.col("rank"), F.col("epoch"))).otherwise(F.col("p"))
    whole = F.least(F.lit(block_words), F.col("source_size") - F.col("p") * block_words)
    rest = F.col("words") - F.col("epoch") * F.col("source_size") - F.col("p") * block_words
    return each.select("shard", "rank", "slot", block.alias("block"), F.least(whole, rest).alias("words"))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (1, 2, 3),
    cap: float = 3.0,
    block_words: int = 512,
    shard_slots: int = 4096,
    seed: int = 17,
    number: Column | None = None,
) -> Mix:
    """Plan the mix of ``docs`` (doc_id, text, source): which words of which document each slot takes.

    No document is taken more than ``cap`` (rounded up) times. ``number`` tells rows apart; it is kept in the plan.
    """
    number = F.monotonically_increasing_id() if number is None else number
    base = docs.select(
        "doc_id", F.col("source").alias("src"), word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text", "source").alias("row"), number.alias("number"),
    )
    base = materialize(base, "mix-sizes")
    base = base.withColumn("bucket", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(root_buckets(base.count()))))
    sums = base.groupBy("src", "bucket").agg(F.sum("size").alias("words_in"))
    sources = targets(sums.groupBy("src").agg(F.sum("words_in").alias("source_size")), weights, cap)
    sources = sources.select(
        "src",
        "rank",
        "source_size",
        "target",
        F.round("target").cast("long").alias("words"),
        F.expr(f"source_size div {block_words}").alias("full"),
        F.expr(f"(source_size + {block_words - 1}) div {block_words}").alias("blocks"),
    )
    quota = F.expr(f"if(source_size = 0, 0, words div source_size * blocks + (words % source_size + {block_words - 1}) div {block_words})")
    sources = sources.withColumn("quota", quota)
    sources = materialize(sources.withColumn("quota_from", F.sum("quota").over(Window.orderBy("rank")) - F.col("quota")), "mix-sources")  # one row per source
    slots = sources.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    before = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("words_in").over(before), F.lit(0)))
    offsets = offsets.alias("o").join(sources.alias("s"), F.expr("o.src <=> s.src")).select("o.src", "o.bucket", "o.offset", "s.rank", "s.source_size", "s.target")
    placed = base.alias("b").join(offsets.alias("o"), F.expr("b.src <=> o.src and b.bucket = o.bucket")).select(
        "o.rank", "b.bucket", "b.doc_id", "b.size", "b.row", "b.number", "o.offset", "o.source_size", "o.target",
    )
    within = Window.partitionBy("rank", "bucket").orderBy("doc_id", "size", "row", "number")
    run = F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.select(
        "rank",
        "bucket",
        F.row_number().over(within).alias("rn"),
        "doc_id",
        "size",
        "number",
        (F.col("offset") + run - F.col("size")).alias("start"),
        "source_size",
        "target",
    )
    pieces = placed.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.expr(f"sequence(start div {block_words}, (start + size - 1) div {block_words})"))))
    slot = slots_of(sources, slots, block_words, shard_slots, seed)
    lo = F.greatest(F.col("start"), F.col("block") * block_words)
    hi = F.least(F.col("start") + F.col("size"), F.col("block") * block_words + F.coalesce("words", F.lit(0)))
    taken = pieces.join(slot.hint("merge"), ["rank", "block"], "left").withColumn("lo", lo).withColumn("hi", F.greatest(lo, hi))
    return Mix(sources, placed, taken)


def taken_words(plan: Mix) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken."""
    keys = ["rank", "bucket", "rn", "doc_id", "size", "source_size", "target"]
    return plan.taken.groupBy(*keys).agg(F.coalesce(F.sum(F.col("hi") - F.col("lo")), F.lit(0)).alias("taken")).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, as rows of ``docs``' document columns: one row per taken segment, its text cut to
    the words taken (white space kept), n_chars set anew. Each text is split into words once."""
    columns = [c for c in ("doc_id", "text", "lang", "source", "n_chars") if c in docs.columns]
    rows = materialize(docs.select(*columns, F.monotonically_increasing_id().alias("number")), "mix-documents")
    plan = mix(rows, **options, number=F.col("number"))
    segment = F.struct((F.col("lo") - F.col("start")).cast("int").alias("from"), (F.col("hi") - F.col("lo")).cast("int").alias("n"))
    cuts = plan.taken.where("hi > lo").groupBy("number", "size").agg(F.collect_list(segment).alias("segments"))
    words = F.regexp_extract_all("text", F.lit(rf"(?:\A[\x20\x09-\x0D]+)?{WORD}[\x20\x09-\x0D]*"), F.lit(0))
    whole = F.forall("segments", lambda s: s["n"] == F.col("size"))
    # A generator's output, so that the split is not merged into each segment's expression and done anew.
    split = F.explode(F.array(F.when(whole, F.array().cast("array<string>")).otherwise(words))).alias("words")
    joined = rows.join(cuts, "number").select(*columns, "size", "segments", split)
    part = lambda s: F.when(s["n"] == F.col("size"), F.col("text")).otherwise(F.array_join(F.slice("words", s["from"] + 1, s["n"]), ""))
    joined = joined.select(*[c for c in columns if c != "text"], F.explode(F.transform("segments", part)).alias("text"))
    if "n_chars" in columns:
        joined = joined.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return joined.select(*columns)
