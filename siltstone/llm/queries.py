"""One whole-table query per training-data operator, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, htmltext, langid, linededup, media, mixing, neardup, packing, quality
from .common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(mixing.mix(table(spark, sf_dir, "documents")))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(table(spark, sf_dir, "documents"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search_table(table(spark, sf_dir, "embeddings"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat.digest(chat.format_conversations(turns.unionByName(extra)))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


OP6_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, coalesce(lag(role) OVER w = role, false) AS merged,
         length(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lb;'), ']', '&rb;')) AS text_len,
         length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lb;'), ']', '&rb;')) AS role_len
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(7 + sum(7 + role_len + text_len + CASE WHEN merged THEN 0 ELSE 5 END) AS BIGINT) AS formatted_chars,
       CAST(coalesce(sum(text_len) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS masked_chars
FROM marked GROUP BY conv_id
"""

OP9_SQL = r"""
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
lines AS (
  SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM docs)
), summed AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM lines),
spans AS ( -- the shortest runs of 8 words from and up to each line
  SELECT a.doc_id, a.pos AS b, min(z.pos) AS e FROM summed a JOIN summed z ON z.doc_id = a.doc_id AND z.pos >= a.pos AND z.upto - a.upto + a.words >= 8 GROUP BY 1, 2
  UNION
  SELECT z.doc_id, max(a.pos), z.pos FROM summed z JOIN summed a ON z.doc_id = a.doc_id AND z.pos >= a.pos AND z.upto - a.upto + a.words >= 8 GROUP BY z.doc_id, z.pos
), runs AS (SELECT s.doc_id, b, e, array_to_string(parts[b:e], chr(10)) AS run FROM spans s JOIN docs d ON d.doc_id = s.doc_id),
held AS (SELECT *, min(doc_id) OVER (PARTITION BY run) AS holder FROM runs),
gone AS (SELECT DISTINCT doc_id, unnest(range(b, e + 1)) AS pos FROM held WHERE holder < doc_id),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos WHERE g.pos IS NULL GROUP BY 1),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, coalesce(x.n, 0) AS n_removed
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id LEFT JOIN lost x ON x.doc_id = d.doc_id
"""

OP10_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM docs
), sized AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM sets),
pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v, any_value(a.n) + any_value(b.n) AS n, count(*) AS c
  FROM sized a JOIN sized b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY 1, 2
), links AS (SELECT u, v FROM pairs WHERE 100 * c >= 85 * (n - c)), edges AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.v FROM reach r JOIN edges e ON e.u = r.other),
least_of AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least_of m ON m.doc_id = d.doc_id LEFT JOIN sizes z ON z.doc_id = d.doc_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_quality": op2_quality,
    "op3_packing": op3_packing,
    "op4_media": op4_media,
    "op5_nearest": op5_nearest,
    "op6_chat": op6_chat,
    "op7_html_text": op7_html_text,
    "op8_language_id": op8_language_id,
    "op9_line_dedup": op9_line_dedup,
    "op10_near_duplicates": op10_near_duplicates,
}
#: For documents of unique ids without scripts that lack spaces, as the given ones are.
ORACLE_SQL: dict[str, str] = {"op6_chat": OP6_SQL, "op9_line_dedup": OP9_SQL, "op10_near_duplicates": OP10_SQL}
