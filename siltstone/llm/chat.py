"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs and sorted; adjacent turns of one role share a
block; the pieces are concatenated. The grammar of the output::

    <s> ( [role:NAME] text ( [turn:NAME] text )* [end] )* </s>

``[role:`` opens a block, ``[turn:`` starts another turn merged into it, ``[end]`` closes it. Inside
names and texts the characters ``& < [ ]`` become entities, so no control string can occur there and
reading back is exact.

Defined cases: null text and null role count as empty; rows tie on ``turn`` by role, then text (nulls
first); repeated rows are turns of their own; rows with null ``conv_id`` form one conversation; an
empty table gives an empty result; other columns are ignored. A conversation is one row, so it
must fit in a task (Spark's limit of 2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed entities, in the order of escaping.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lb;"), ("]", "&rb;"))


def escape(text: Column) -> Column:
    for raw, entity in ENTITIES:
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def unescape(text: Column) -> Column:
    for raw, entity in reversed(ENTITIES):
        text = F.replace(text, F.lit(entity), F.lit(raw))
    return text


def format_conversations(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_runs.

    ``loss_runs`` is the loss mask as run lengths, one entry per turn: ``skip`` code points without
    loss, then ``take`` code points under the loss; what follows the last run has no loss.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text")).alias("t"))
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))

    def piece(x: Column, i: Column) -> Column:
        at = F.col("t")
        opens = (i == 0) | (F.get(at, i - 1)["role"] != x["role"])
        closes = F.coalesce(F.get(at, i + 1)["role"] != x["role"], F.lit(True))
        mark = F.concat(F.when(opens, "[role:").otherwise("[turn:"), escape(x["role"]), F.lit("]"))
        return F.struct(
            mark.alias("mark"), escape(x["text"]).alias("body"), F.when(closes, "[end]").otherwise("").alias("end"), x["role"].isin(*loss_roles).alias("loss"),
        )

    pieces = sorted_turns.select("conv_id", F.transform("t", piece).alias("p"))

    def run(x: Column, i: Column) -> Column:
        before = F.when(i == 0, 3).otherwise(F.coalesce(F.length(F.get(F.col("p"), i - 1)["end"]), F.lit(0)))
        skip, own = before + F.length(x["mark"]), F.length(x["body"])
        return F.struct(F.when(x["loss"], skip).otherwise(skip + own).alias("skip"), F.when(x["loss"], own).otherwise(0).alias("take"))

    whole = F.array_join(F.transform("p", lambda x: F.concat(x["mark"], x["body"], x["end"])), "")
    return pieces.select("conv_id", F.concat(F.lit("<s>"), whole, F.lit("</s>")).alias("formatted"), F.transform("p", run).alias("loss_runs"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse formatted conversations: conv_id, turns (role, text) and loss_text, all unescaped.

    ``loss_text`` is what lies under the mask: in each turn, the ``take`` code points that follow its
    ``skip``.
    """
    parts = formatted.select("conv_id", "formatted", "loss_runs", F.split("formatted", r"\[").alias("s"))
    pieces = F.filter(F.slice("s", F.lit(2), F.size("s")), lambda x: ~x.startswith("end]"))
    marked = F.transform(pieces, lambda x: F.struct(F.substring_index(x, "]", 1).alias("mark"), x.alias("piece")))
    parsed = parts.select("conv_id", "formatted", "loss_runs", marked.alias("m"))
    body = lambda x: F.substr(x["piece"], F.length(x["mark"]) + 2)
    name = lambda x: F.substr(x["mark"], F.lit(6))
    turns = F.transform("m", lambda x: F.struct(unescape(name(x)).alias("role"), unescape(body(x)).alias("text")))
    under = F.zip_with("m", "loss_runs", lambda x, r: F.when(r["take"] > 0, unescape(F.substr(body(x), F.lit(1), r["take"]))))
    return parsed.select("conv_id", "formatted", "loss_runs", turns.alias("turns"), F.array_join(under, "").alias("loss_text"))


def digest(formatted: DataFrame) -> DataFrame:
    """Digest columns read back from formatted conversations."""
    whole = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read_back(formatted).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.aggregate("loss_runs", F.lit(0).cast("long"), lambda s, r: s + r["take"]).alias("masked_chars"),
    )
