"""Training-corpus pipeline over ``documents``: language ID, line dedup, near-dedup, mixing, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that
is written as Parquet and read again as the next one's ``docs``. All but the last return the columns of
``docs``; the last returns the packed documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import langid, linededup, mixing, neardup, packing
from siltstone.llm.common import WORD, materialize, scope, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no language that the network knows, go."""
    return langid.keep_identified(docs, langid.train(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines shared with an earlier document are deleted; documents left without a word go."""
    out = linededup.deduped(docs)
    text = F.col("doc").getField("text")
    own = {c: F.col("doc").getField(c) for c in docs.columns}
    if "n_chars" in own:
        own["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return out.where((F.col("removed") == 0) | text.rlike(WORD)).select(*[x.alias(c) for c, x in own.items()])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8 or more. Rows of one id stay or go together."""
    gone = neardup.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 1, 2, 3: rows are the segments taken, repeats included."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-budget batches in optimal length buckets."""
    return packing.pack(docs, keep=("text",))


STAGES = [("language_id", language), ("line_dedup", lines), ("near_dedup", near_duplicates), ("mixing", mix), ("packing", pack)]

#: The stages of language ID, line dedup and mixing can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scope() as keep:
        docs = table(spark, sf_dir, "documents")
        for name, stage in STAGES[:-1]:
            with scope() as keep_stage:  # what a stage wrote goes when its result is written
                docs = keep_stage(materialize(stage(spark, docs, sf_dir), f"stage-{name}"))
        keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
