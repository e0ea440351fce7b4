"""Queries over the driver's tables, one or more for each operator, and the SQL that checks them.

The tables stand for the model: documents are files (path language/source/id), three derived
snapshots leave out and alter some; lineitem is a manifest (order = pack, part = blob), part the
reachable set, events are snapshots or cache rows, region to orders a hierarchy of four levels.
Digests here are SHA-256, which the checking engine has too; ids proper are SHA-224.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..functions import ids, kinds, paths, sizes, times
from ..operators import cache, chunking, dedup, diff, filters, packs, restore, snapshots, trees, verify
from ..sources.tables import table
from ..streaming import ingest, progress

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query by its function's name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# -- the model's tables

_FILES = """
snaps AS (SELECT unnest([0, 1, 2]) AS snap),
files AS (
  SELECT snap, lang || '/' || source || '/' || doc_id AS path,
         CASE WHEN snap = 2 AND doc_id % 11 = 0 THEN text || '!' ELSE text END AS body, doc_id
  FROM documents, snaps WHERE doc_id % 5 <> snap
)"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three snapshots of the documents: snapshot k leaves out ids that are k modulo 5, the last alters some."""
    docs = table(spark, sf_dir, "documents").withColumn("snap", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).where(F.col("doc_id") % 5 != F.col("snap"))
    body = F.when((F.col("snap") == 2) & (F.col("doc_id") % 11 == 0), F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return docs.select("snap", _path().alias("path"), body.alias("body"), "doc_id")


def _path() -> Column:
    return F.concat_ws("/", "lang", "source", "doc_id")


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return files.select(
        "snap",
        "path",
        paths.parts(F.col("path")).alias("parts"),
        ids.digest(F.col("body"), 256).alias("blob_id"),
        F.octet_length("body").cast("long").alias("length"),
    )


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return items.select(F.col("l_orderkey").alias("pack_id"), F.col("l_partkey").alias("blob_id"), F.col("l_quantity").cast("long").alias("length"))


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_size < 40").select(F.col("p_partkey").alias("blob_id"))


def _moment(c: str = "ts") -> Column:
    """Microseconds of a time without zone."""
    return F.unix_micros(F.col(c).cast("timestamp"))


# -- ids and chunks


@query("SELECT doc_id, sha256(text) AS blob_id, CAST(strlen(text) AS BIGINT) AS length FROM documents")
def content_hash(spark, sf_dir):
    """X1"""
    return table(spark, sf_dir, "documents").select(
        "doc_id", ids.digest(F.col("text"), 256).alias("blob_id"), F.octet_length("text").cast("long").alias("length"),
    )


@query()
def object_id_base32(spark, sf_dir):
    """Ids proper, their short form, and the digest read back"""
    docs = table(spark, sf_dir, "documents").select("doc_id", ids.object_id(F.col("text")).alias("blob_id"))
    return docs.select("doc_id", "blob_id", ids.short_id(F.col("blob_id")).alias("short"), ids.base32_to_hex(F.col("blob_id")).alias("digest"))


_SYMBOL = "substr('0123456789abcdefghijklmnopqrstuv', ({}) + 1, 1)"


@query(f"""
SELECT doc_id, digest, substr(blob_id, 1, 8) AS short, blob_id FROM (
  SELECT doc_id, h AS digest, array_to_string(list_transform(range(0, 11), lambda i: array_to_string(list_transform([15, 10, 5, 0],
    lambda s: {_SYMBOL.format("(CAST('0x' || substr(h, 1 + 5 * i, 5) AS INT) >> s) & 31")}), '')), '') || {_SYMBOL.format("CAST('0x' || substr(h, 56, 1) AS INT) * 2")} AS blob_id
  FROM (SELECT doc_id, substr(sha256(text), 1, 56) AS h FROM documents))
""")
def base32_text(spark, sf_dir):
    """224 bits as an id's text, its short form, and the digits read back"""
    docs = table(spark, sf_dir, "documents").select("doc_id", ids.base32(F.left(ids.digest(F.col("text"), 256), F.lit(56))).alias("blob_id"))
    return docs.select("doc_id", ids.base32_to_hex(F.col("blob_id")).alias("digest"), ids.short_id(F.col("blob_id")).alias("short"), "blob_id")


@query("SELECT doc_id, sha1(text) AS checksum FROM documents")
def upload_checksum(spark, sf_dir):
    """The SHA-1 that an upload is sent with"""
    return table(spark, sf_dir, "documents").select("doc_id", ids.checksum(F.col("text")).alias("checksum"))


@query("""
SELECT doc_id, seq, CAST(strlen(chunk) AS BIGINT) AS length, sha256(chunk) AS blob_id
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS chunk, unnest(range(len(string_split(text, chr(10))))) AS seq FROM documents)
""")
def line_chunks(spark, sf_dir):
    """T1 with lines as chunks"""
    return chunking.line_chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 256).withColumn("seq", F.col("seq").cast("long"))


@query()
def cdc_chunks(spark, sf_dir):
    """T1 content-defined, at small sizes"""
    return chunking.content_chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 256, 1024, 8192).drop("bytes")


# -- dedup


@query("SELECT sha256(text) AS blob_id, min(doc_id) AS first_doc_id, count(*) AS copies, max(CAST(strlen(text) AS BIGINT)) AS length FROM documents GROUP BY 1")
def dedup_blobs(spark, sf_dir):
    """Each content once"""
    return dedup.distinct_blobs(content_hash(spark, sf_dir), "blob_id", "doc_id", "length")


@query("""
SELECT DISTINCT sha256(text) AS blob_id FROM documents WHERE doc_id % 3 <> 0
AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)
""")
def dedup_against_stored(spark, sf_dir):
    """New contents, against a third of the documents as stored ones"""
    hashed = content_hash(spark, sf_dir)
    return dedup.new_blobs(hashed.where("doc_id % 3 <> 0"), hashed.where("doc_id % 3 = 0")).select("blob_id")


@query("""
SELECT lang, CAST(coalesce(sum(n) FILTER (WHERE r = 1), 0) AS BIGINT) AS introduced, CAST(coalesce(sum(n) FILTER (WHERE r > 1), 0) AS BIGINT) AS reused
FROM (SELECT lang, strlen(text) AS n, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS r FROM documents) GROUP BY lang
""")
def dedup_ratio_by_lang(spark, sf_dir):
    """Bytes introduced and reused"""
    docs = table(spark, sf_dir, "documents").select(
        "lang", "doc_id", ids.digest(F.col("text"), 256).alias("blob_id"), F.octet_length("text").cast("long").alias("length"),
    )
    return dedup.introduced(docs, "blob_id", "length", [F.col("doc_id")], ["lang"])


@query(f"""
WITH {_FILES}
SELECT snap, CAST(sum(CASE WHEN r = 1 THEN n ELSE 0 END) AS BIGINT) AS introduced, CAST(sum(CASE WHEN r > 1 THEN n ELSE 0 END) AS BIGINT) AS reused
FROM (SELECT snap, strlen(body) AS n, row_number() OVER (PARTITION BY sha256(body) ORDER BY snap, string_split(path, '/')) AS r FROM files) GROUP BY snap
""")
def snapshot_sizes(spark, sf_dir):
    """A9 W1 A12"""
    return dedup.introduced(_refs(spark, sf_dir), "blob_id", "length", [F.col("snap"), F.col("parts")], ["snap"])


@query(f"""
WITH {_FILES}
SELECT snap, path, introduced, reused FROM (
  SELECT snap, path, CAST(sum(CASE WHEN r = 1 THEN n ELSE 0 END) AS BIGINT) AS introduced, CAST(sum(CASE WHEN r > 1 THEN n ELSE 0 END) AS BIGINT) AS reused
  FROM (SELECT snap, path, strlen(body) AS n, row_number() OVER (PARTITION BY sha256(body) ORDER BY snap, string_split(path, '/')) AS r FROM files) GROUP BY snap, path
) WHERE introduced > 0
""")
def file_sizes(spark, sf_dir):
    """Files that add anything, largest first"""
    refs = _refs(spark, sf_dir)
    found = dedup.introduced(refs, "blob_id", "length", [F.col("snap"), F.col("parts")], ["snap", "parts"])
    return filters.introducing(found).select("snap", F.array_join("parts", "/").alias("path"), "introduced", "reused")


# -- comparing


def _sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    files = _refs(spark, sf_dir).select(
        "snap",
        "path",
        F.when(F.col("length") % 7 == 0, "symlink").otherwise("file").alias("kind"),
        F.col("blob_id").alias("chunks"),
        F.when(F.col("length") % 7 == 0, F.col("length").cast("string")).alias("target"),
    )
    return files.where("snap = 1").drop("snap"), files.where("snap = 2").drop("snap")


@query(f"""
WITH {_FILES},
f AS (SELECT snap, path, sha256(body) AS h, strlen(body) AS n, strlen(body) % 7 = 0 AS link FROM files),
j AS (SELECT coalesce(a.path, b.path) AS path, a.path AS ap, b.path AS bp, a.h AS ah, b.h AS bh, a.link AS al, b.link AS bl, a.n AS an, b.n AS bn
      FROM (SELECT * FROM f WHERE snap = 1) a FULL OUTER JOIN (SELECT * FROM f WHERE snap = 2) b ON a.path = b.path),
k AS (SELECT *, ap IS NOT NULL AND bp IS NOT NULL AND (al <> bl OR (al AND an <> bn)) AS replaced FROM j)
SELECT path, '-' AS code, CASE WHEN al THEN 'symlink' ELSE 'file' END AS kind FROM k WHERE bp IS NULL OR replaced
UNION ALL SELECT path, '+', CASE WHEN bl THEN 'symlink' ELSE 'file' END FROM k WHERE ap IS NULL OR replaced
UNION ALL SELECT path, 'C', 'file' FROM k WHERE ap IS NOT NULL AND bp IS NOT NULL AND NOT replaced AND NOT al AND ah <> bh
""")
def snapshot_diff(spark, sf_dir):
    """Codes between two snapshots, changes of kind and of link targets included"""
    left, right = _sides(spark, sf_dir)
    return diff.compare(left, right, ["path"]).drop("target")


@query(f"""
WITH {_FILES},
f AS (SELECT snap, path, sha256(body) AS h FROM files),
j AS (SELECT coalesce(a.snap + 1, b.snap) AS snap, a.h AS ah, b.h AS bh
      FROM (SELECT * FROM f WHERE snap < 2) a FULL OUTER JOIN f b ON a.path = b.path AND a.snap + 1 = b.snap)
SELECT snap, code, count(*) AS entries FROM (
  SELECT snap, CASE WHEN ah IS NULL THEN '+' WHEN bh IS NULL THEN '-' WHEN ah <> bh THEN 'C' END AS code FROM j
) WHERE code IS NOT NULL GROUP BY snap, code
""")
def snapshot_stat(spark, sf_dir):
    """Each snapshot against the one before"""
    entries = _refs(spark, sf_dir).select(
        "snap", "path", F.lit("file").alias("kind"), F.col("blob_id").alias("chunks"), F.lit(None).cast("string").alias("target"),
    )
    return diff.counts(diff.consecutive(entries.select("snap").distinct(), entries, "snap", ["snap"], ["path"]), "snap")


_META = """
meta AS (SELECT o_orderkey, o_orderkey % 9 = 0 AS windows, o_custkey AS uid, o_orderkey % 13 AS gid,
                CASE WHEN o_orderpriority LIKE '1%' THEN 420 ELSE 493 END AS mode, CAST(epoch_us(o_orderdate) AS BIGINT) AS mtime, o_orderkey % 3 AS atime,
                CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) END AS size FROM orders),
changed AS (SELECT o_orderkey, o_orderkey % 18 = 0 AS windows, CASE WHEN o_orderkey % 5 = 0 THEN uid + 1 ELSE uid END AS uid, gid,
                CASE WHEN o_orderkey % 7 = 0 THEN 511 ELSE mode END AS mode, CASE WHEN o_orderkey % 11 = 0 THEN mtime + 1 ELSE mtime END AS mtime,
                CASE WHEN o_orderkey % 17 = 0 THEN 9 ELSE atime END AS atime, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE size END AS size FROM meta)"""


@query(f"""
WITH {_META}
SELECT m.o_orderkey, CASE
  WHEN m.windows = c.windows AND m.uid = c.uid AND m.gid = c.gid AND m.mode = c.mode AND m.mtime = c.mtime AND m.atime = c.atime AND m.size IS NOT DISTINCT FROM c.size THEN NULL
  WHEN m.windows OR c.windows THEN 'M' WHEN m.uid <> c.uid OR m.gid <> c.gid THEN 'O' WHEN m.mode <> c.mode THEN 'P'
  WHEN m.mtime <> c.mtime THEN 'T' WHEN m.atime <> c.atime THEN 'A' ELSE 'M' END AS code
FROM meta m JOIN changed c USING (o_orderkey)
""")
def metadata_diff_code(spark, sf_dir):
    """Codes of metadata changes, nulls as values"""
    k = F.col("o_orderkey")
    own = {
        "uid": F.col("o_custkey"),
        "gid": k % 13,
        "mode": F.when(F.col("o_orderpriority").startswith("1"), 420).otherwise(493),
        "mtime_ns": _moment("o_orderdate"),
        "atime_ns": k % 3,
        "size": F.when(k % 4 == 0, None).otherwise(F.floor("o_totalprice")),
    }
    new = own | {
        "uid": F.when(k % 5 == 0, own["uid"] + 1).otherwise(own["uid"]),
        "mode": F.when(k % 7 == 0, 511).otherwise(own["mode"]),
        "mtime_ns": F.when(k % 11 == 0, own["mtime_ns"] + 1).otherwise(own["mtime_ns"]),
        "atime_ns": F.when(k % 17 == 0, 9).otherwise(own["atime_ns"]),
        "size": F.when(k % 6 == 0, None).otherwise(own["size"]),
    }

    def meta(fields: dict[str, Column], windows: Column) -> Column:
        named = [fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in (f.split() for f in kinds.META.split(", ")[1:])]
        return F.struct(F.when(windows, "windows").otherwise("posix").alias("meta_type"), *named)

    both = table(spark, sf_dir, "orders").select(k, meta(own, k % 9 == 0).alias("l"), meta(new, k % 18 == 0).alias("r"))
    return both.select("o_orderkey", kinds.metadata_code(F.col("l"), F.col("r")).alias("code"))


@query("""
SELECT doc_id, CASE WHEN (doc_id * 4099 + 4096) % 65536 // 4096 = 10 THEN 'symlink' WHEN (doc_id * 4099 + 4096) % 65536 // 4096 = 4 THEN 'directory'
  WHEN (doc_id * 4099 + 4096) % 65536 // 4096 = 8 THEN 'file' END AS kind,
  CASE WHEN doc_id & 1024 <> 0 THEN 'symlink' WHEN doc_id & 16 <> 0 THEN 'directory' ELSE 'file' END AS windows_kind FROM documents
""")
def kind_of_mode(spark, sf_dir):
    """Kinds from type bits"""
    return table(spark, sf_dir, "documents").select(
        "doc_id", kinds.kind_of_mode((F.col("doc_id") * 4099 + 4096) % 65536).alias("kind"), kinds.kind_of_attributes(F.col("doc_id")).alias("windows_kind"),
    )


# -- hierarchies

_NODES = """
nodes AS (
  SELECT 'r' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS up, 0 AS depth, r_name AS name FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 1, n_name FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 2, c_name FROM customer
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 3, 'order ' || o_orderkey FROM orders
)"""


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def level(name: str, letter: str, key: str, upper: str, up: str | None, depth: int, label: Column) -> DataFrame:
        above = F.concat(F.lit(upper), F.col(up).cast("string")) if up else F.lit(None).cast("string")
        return table(spark, sf_dir, name).select(
            F.concat(F.lit(letter), F.col(key).cast("string")).alias("child"), above.alias("parent"), F.lit(depth).alias("depth"), label.alias("name"),
        )

    out = level("region", "r", "r_regionkey", "", None, 0, F.col("r_name"))
    out = out.unionByName(level("nation", "n", "n_nationkey", "r", "n_regionkey", 1, F.col("n_name")))
    out = out.unionByName(level("customer", "c", "c_custkey", "n", "c_nationkey", 2, F.col("c_name")))
    return out.unionByName(level("orders", "o", "o_orderkey", "c", "o_custkey", 3, F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))))


def _as_trees(nodes: DataFrame) -> DataFrame:
    directory = F.col("depth") < 3
    return nodes.where("parent is not null").select(
        F.col("parent").alias("tree_id"),
        "name",
        F.when(directory, "directory").otherwise("file").alias("kind"),
        F.when(directory, F.col("child")).alias("subtree"),
    )


@query(f"""
WITH {_NODES}
SELECT r.id AS root, p.depth, p.path FROM nodes r JOIN (
  SELECT n.up AS root, 1 AS depth, n.name AS path FROM nodes n WHERE n.depth = 1
  UNION ALL SELECT n.up, 2, n.name || '/' || c.name FROM nodes n JOIN nodes c ON c.up = n.id WHERE n.depth = 1
  UNION ALL SELECT n.up, 3, n.name || '/' || c.name || '/' || o.name FROM nodes n JOIN nodes c ON c.up = n.id JOIN nodes o ON o.up = c.id WHERE n.depth = 1
) p ON p.root = r.id
""")
def tree_flatten(spark, sf_dir):
    """Unfolding a hierarchy of four levels from its roots"""
    nodes = _nodes(spark, sf_dir)
    roots = nodes.where("depth = 0").select(F.col("child").alias("root"), F.col("child").alias("tree_id"))
    return trees.unfold(_as_trees(nodes), roots, ("root",)).select("root", F.col("depth").cast("int").alias("depth"), F.array_join("parts", "/").alias("path"))


@query("SELECT * FROM (VALUES ('x1', 'x2'), ('x2', 'x3'), ('x3', 'x1')) t(parent, child)")
def tree_cycle_check(spark, sf_dir):
    """Edges that close a cycle (three planted ones, and a tail that is none)"""
    edges = _nodes(spark, sf_dir).where("parent is not null").select("parent", "child")
    planted = spark.createDataFrame([("x1", "x2"), ("x2", "x3"), ("x3", "x1"), ("x3", "x4"), ("x0", "x1")], "parent string, child string")
    return trees.cycles(edges.unionByName(planted))


@query(f"""
WITH {_NODES},
d3 AS (SELECT id, up, sha256(name) AS digest FROM nodes WHERE depth = 3),
d2 AS (SELECT n.id, n.up, coalesce(k.digest, sha256(n.name)) AS digest FROM nodes n LEFT JOIN (SELECT up, sha256(string_agg(id || '=' || digest, ',' ORDER BY id || '=' || digest)) AS digest FROM d3 GROUP BY up) k ON k.up = n.id WHERE n.depth = 2),
d1 AS (SELECT n.id, n.up, coalesce(k.digest, sha256(n.name)) AS digest FROM nodes n LEFT JOIN (SELECT up, sha256(string_agg(id || '=' || digest, ',' ORDER BY id || '=' || digest)) AS digest FROM d2 GROUP BY up) k ON k.up = n.id WHERE n.depth = 1),
d0 AS (SELECT n.id, n.up, coalesce(k.digest, sha256(n.name)) AS digest FROM nodes n LEFT JOIN (SELECT up, sha256(string_agg(id || '=' || digest, ',' ORDER BY id || '=' || digest)) AS digest FROM d1 GROUP BY up) k ON k.up = n.id WHERE n.depth = 0)
SELECT id AS node, 0 AS depth, digest FROM d0 UNION ALL SELECT id, 1, digest FROM d1 UNION ALL SELECT id, 2, digest FROM d2 UNION ALL SELECT id, 3, digest FROM d3
""")
def merkle_rollup(spark, sf_dir):
    """Digests of all levels, bottom up"""
    combine = lambda children: F.sha2(F.array_join(children, ","), 256)
    return trees.roll_up(_nodes(spark, sf_dir), F.sha2("name", 256), combine)


@query(f"WITH {_NODES} SELECT id AS child, CASE WHEN depth < 3 THEN name || '/' ELSE name END AS line FROM nodes WHERE up = 'n7'")
def dump_listing(spark, sf_dir):
    """T5: one directory's lines"""
    nodes = _nodes(spark, sf_dir)
    found = trees.listing(_as_trees(nodes).withColumn("target", F.lit(None).cast("string")), "n7")
    return found.join(nodes.where("parent = 'n7'").select("name", "child"), "name").select("child", "line")


# -- references, packs and indexes


@query(f"WITH {_FILES} SELECT DISTINCT sha256(body) AS blob_id FROM files WHERE snap < 2")
def reachable_blobs(spark, sf_dir):
    """A1 A2: what two snapshots reach"""
    return packs.reachable(_refs(spark, sf_dir).where("snap < 2"), "blob_id")


@query(f"WITH {_FILES} SELECT sha256(body) AS blob_id, string_agg(DISTINCT CAST(snap AS VARCHAR), ',' ORDER BY CAST(snap AS VARCHAR)) AS snapshots FROM files GROUP BY 1")
def chunk_to_snapshots(spark, sf_dir):
    """A5"""
    return packs.users(_refs(spark, sf_dir), "blob_id", "snap").select(
        "blob_id", F.array_join(F.transform("snapshots", lambda s: s.cast("string")), ",").alias("snapshots"),
    )


_CLASSES = """
classes AS (
  SELECT l_orderkey AS pack_id, count(*) AS entries, count(p.p_partkey) AS live_entries, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS bytes,
         CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) FILTER (WHERE p.p_partkey IS NOT NULL), 0) AS BIGINT) AS live_bytes
  FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size < 40) p ON l_partkey = p_partkey GROUP BY 1
)"""


@query(f"""
WITH {_CLASSES}
SELECT CASE WHEN live_entries = entries THEN 'reusable' WHEN live_entries = 0 THEN 'droppable' ELSE 'sparse' END AS "class",
       count(*) AS packs, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(live_bytes) AS BIGINT) AS live_bytes FROM classes GROUP BY 1
""")
def pack_partition(spark, sf_dir):
    """A6 A7 A8 J17"""
    return packs.class_totals(packs.classify(_manifest(spark, sf_dir), _live(spark, sf_dir), "pack_id", "blob_id", "length"))


@query(f"WITH {_CLASSES} SELECT pack_id, CASE WHEN live_entries = entries THEN 'keep' WHEN live_entries = 0 THEN 'drop' ELSE 'rewrite' END AS action, bytes, live_bytes FROM classes")
def prune_plan(spark, sf_dir):
    """Action by pack"""
    return packs.prune_plan(_manifest(spark, sf_dir), _live(spark, sf_dir), "pack_id", "blob_id", "length")


@query(f"""
WITH {_CLASSES.replace("p_size < 40", "p_size < 10")}, kept AS (SELECT l_partkey FROM lineitem JOIN classes ON l_orderkey = pack_id WHERE live_entries = entries)
SELECT DISTINCT l_partkey AS blob_id FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 10 AND l_partkey NOT IN (SELECT l_partkey FROM kept)
""")
def repack_blobs(spark, sf_dir):
    """Live blobs (here of small parts) outside all reusable packs"""
    manifest = _manifest(spark, sf_dir)
    live = table(spark, sf_dir, "part").where("p_size < 10").select(F.col("p_partkey").alias("blob_id"))
    classes = packs.classify(manifest, live, "pack_id", "blob_id", "length")
    return packs.to_repack(manifest, live, classes, "pack_id", "blob_id")


@query(f"""
WITH {_FILES}
SELECT sha256(body) AS blob_id, count(DISTINCT snap) AS snapshots, min(snap) AS first_snapshot FROM files
WHERE sha256(body) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0) GROUP BY 1
""")
def missing_chunks(spark, sf_dir):
    """Chunks in use that no pack holds (packs hold half of the documents)"""
    held = content_hash(spark, sf_dir).where("doc_id % 2 = 0").select("blob_id")
    return packs.missing_chunks(_refs(spark, sf_dir), held, "blob_id", "snap")


@query("SELECT DISTINCT l_orderkey AS pack_id FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')")
def missing_packs(spark, sf_dir):
    """Indexed, but not listed"""
    listed = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("pack_id"))
    return packs.missing(_manifest(spark, sf_dir), listed, "pack_id")


@query("SELECT o_orderkey AS pack_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def unreachable_packs(spark, sf_dir):
    """Listed, but not indexed"""
    return packs.missing(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pack_id")), _manifest(spark, sf_dir), "pack_id")


@query("""
SELECT DISTINCT l_orderkey AS pack_id FROM lineitem
WHERE l_suppkey NOT IN (SELECT s_suppkey + 1 FROM supplier WHERE s_nationkey < 5)
""")
def master_index(spark, sf_dir):
    """Suppliers are indexes; some supersede their successor"""
    entries = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("index_id"), F.col("l_orderkey").alias("pack_id"))
    gone = table(spark, sf_dir, "supplier").where("s_nationkey < 5").select((F.col("s_suppkey") + 1).alias("superseded_id"))
    return packs.master_index(entries, gone).select("pack_id")


@query("SELECT l_partkey AS blob_id, count(*) AS entries, min(l_orderkey) AS first_pack, max(l_orderkey) AS last_pack FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def index_uniqueness(spark, sf_dir):
    """A3: blobs that are packed twice"""
    return dedup.uniqueness_violations(_manifest(spark, sf_dir))


@query("SELECT l_partkey AS blob_id, min(l_orderkey) AS pack_id FROM lineitem GROUP BY 1")
def blob_to_pack(spark, sf_dir):
    """Blob to its pack, the least if there are several"""
    return dedup.blob_map(_manifest(spark, sf_dir).select("blob_id", "pack_id"))


@query("SELECT doc_id, sha256(text || '?') AS actual_id FROM documents WHERE doc_id % 97 = 3")
def verify_blobs(spark, sf_dir):
    """planted corruption is found"""
    stored = table(spark, sf_dir, "documents").select(
        "doc_id",
        ids.digest(F.col("text"), 256).alias("blob_id"),
        F.when(F.col("doc_id") % 97 == 3, F.concat("text", F.lit("?"))).otherwise(F.col("text")).alias("content"),
    )
    return verify.corrupt_blobs(stored, "content", bits=256).select("doc_id", "actual_id")


@query("""
SELECT count(*) AS packs, CAST(sum(n) AS BIGINT) AS blobs, count(*) FILTER (WHERE bad > 0) AS broken_packs, CAST(sum(bad) AS BIGINT) AS broken_blobs
FROM (SELECT source, count(*) AS n, count(*) FILTER (WHERE doc_id % 97 = 3) AS bad FROM documents GROUP BY source)
""")
def verification_totals(spark, sf_dir):
    """Packs and blobs read, and broken ones (sources are packs)"""
    stored = table(spark, sf_dir, "documents").select(
        "source",
        ids.digest(F.col("text"), 256).alias("blob_id"),
        F.when(F.col("doc_id") % 97 == 3, F.concat("text", F.lit("?"))).otherwise(F.col("text")).alias("content"),
    )
    return verify.verification_totals(stored, "content", "source", bits=256)


@query(f"""
WITH {_FILES},
refs AS (SELECT snap, path, sha256(body) AS h, strlen(body) AS n, row_number() OVER (PARTITION BY sha256(body) ORDER BY snap, string_split(path, '/')) AS r FROM files),
held AS (SELECT count(DISTINCT source) AS packs, sum(n) AS packed FROM (SELECT sha256(text) AS h, min(source) AS source, max(strlen(text)) AS n FROM documents GROUP BY 1))
SELECT (SELECT count(DISTINCT snap) FROM files) AS snapshots, CAST(sum(n) FILTER (WHERE r = 1) AS BIGINT) AS unique_bytes,
       CAST(sum(n) FILTER (WHERE r > 1) AS BIGINT) AS reused_bytes, (SELECT packs FROM held) AS packs, CAST((SELECT packed FROM held) AS BIGINT) AS packed_bytes,
       CAST((SELECT packed FROM held) - sum(n) FILTER (WHERE r = 1 AND h IN (SELECT sha256(text) FROM documents)) AS BIGINT) AS unused_bytes FROM refs
""")
def usage_summary(spark, sf_dir):
    """One row (documents are what is packed, sources the packs)"""
    refs = _refs(spark, sf_dir)
    order = [F.col("snap"), F.col("parts")]
    total = dedup.introduced(refs, "blob_id", "length", order, ["snap"]).agg(
        F.count(F.lit(1)).alias("snapshots"), F.sum("introduced").alias("unique_bytes"), F.sum("reused").alias("reused_bytes"),
    )
    docs = table(spark, sf_dir, "documents").select(
        ids.digest(F.col("text"), 256).alias("blob_id"), F.col("source").alias("pack_id"), F.octet_length("text").cast("long").alias("length"),
    )
    held = dedup.blob_map(docs, "length")
    packed = held.agg(F.count_distinct("pack_id").alias("packs"), F.sum("length").alias("packed_bytes"))
    used = held.join(packs.reachable(refs, "blob_id"), "blob_id", "left_semi").agg(F.sum("length").alias("used"))
    row = total.crossJoin(packed).crossJoin(used)  # one row each
    return row.select("snapshots", "unique_bytes", "reused_bytes", "packs", "packed_bytes", (F.col("packed_bytes") - F.col("used")).alias("unused_bytes"))


@query("""
SELECT l_orderkey AS pack_id, count(*) AS entries, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS blobs FROM lineitem GROUP BY 1
""")
def manifest_rows(spark, sf_dir):
    """A pack's entries in order"""
    items = table(spark, sf_dir, "lineitem")
    listed = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    return items.groupBy(F.col("l_orderkey").alias("pack_id")).agg(
        F.count(F.lit(1)).alias("entries"), F.array_join(F.transform(listed, lambda x: x["l_partkey"].cast("string")), ",").alias("blobs"),
    )


@query("""
SELECT CASE WHEN side IS NULL THEN NULL ELSE pack_id END AS pack_id, side FROM (
  SELECT coalesce(a.o_orderkey, b.o_orderkey) AS pack_id, CASE WHEN b.o_orderkey IS NULL THEN 'lost' WHEN a.o_orderkey IS NULL THEN 'new' END AS side
  FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 < 7) a FULL OUTER JOIN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 > 1) b ON a.o_orderkey = b.o_orderkey
) WHERE side IS NOT NULL
""")
def set_differences(spark, sf_dir):
    """What one set has and the other lacks, both ways"""
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pack_id"))
    a, b = keys.where("pack_id % 10 < 7"), keys.where("pack_id % 10 > 1")
    return packs.missing(a, b, "pack_id").withColumn("side", F.lit("lost")).unionByName(packs.missing(b, a, "pack_id").withColumn("side", F.lit("new")))


# -- snapshots (events)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("snapshot_id"), _moment().alias("time_us"), "user_id", F.col("event_type").alias("tree_id"), F.col("value"),
    )


@query("SELECT snapshot_id FROM (SELECT event_id AS snapshot_id, event_type AS t, lag(event_type) OVER (ORDER BY ts, event_id) AS p FROM events) WHERE t = p")
def forget_duplicates(spark, sf_dir):
    """Snapshots that repeat the one before"""
    return snapshots.repeats(_events(spark, sf_dir), "tree_id", [F.col("time_us"), F.col("snapshot_id")]).select("snapshot_id")


@query("SELECT event_id AS snapshot_id, event_type AS tree_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1 OFFSET 3")
def snapshot_last_n(spark, sf_dir):
    """LAST~3"""
    return snapshots.select(_events(spark, sf_dir), "LAST~3", "time_us").select("snapshot_id", "tree_id")


@query("SELECT doc_id, sha256(CAST(doc_id AS VARCHAR)) AS snapshot_id, count(*) OVER () AS matches FROM documents WHERE sha256(CAST(doc_id AS VARCHAR)) LIKE 'a1%'")
def snapshot_prefix(spark, sf_dir):
    """what a prefix matches, and how often"""
    named = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("snapshot_id"))
    return snapshots.by_prefix(named, "a1")


@query("SELECT user_id, event_id AS snapshot_id, event_type AS tree_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def parent_snapshot(spark, sf_dir):
    """F8: the newest of each group (users are path sets)"""
    return snapshots.latest_by(_events(spark, sf_dir), "user_id", "time_us", "snapshot_id", "tree_id").select("user_id", "snapshot_id", "tree_id")


@query("SELECT event_id AS snapshot_id FROM events WHERE event_id IN (3, 5, 7, 400)")
def selected_snapshots(spark, sf_dir):
    """A list of selectors, repeats dropped, in order of time"""
    wanted = spark.createDataFrame([(7,), (3,), (3,), (5,), (400,)], "snapshot_id long").distinct()
    return snapshots.chronological(_events(spark, sf_dir).join(wanted, "snapshot_id", "left_semi"), "time_us").select("snapshot_id")


@query("SELECT event_id AS name, value AS size FROM (SELECT *, sum(value) OVER (ORDER BY ts DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT event_id, ts, round(value * 100) AS value FROM events)) WHERE coalesce(before, 0) >= 1000000")
def lru_evict(spark, sf_dir):
    """What a cache of a million drops"""
    rows = _events(spark, sf_dir).select(F.col("snapshot_id").alias("name"), "time_us", F.round(F.col("value") * 100).alias("size"))
    return cache.evict(rows, 1_000_000, "size", [F.desc("time_us"), F.desc("name")]).select("name", "size")


@query("""
SELECT event_id AS name, value AS size FROM (
  SELECT *, sum(value) OVER (ORDER BY ts DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM (SELECT event_id, ts, round(value * 100) AS value FROM events)) WHERE coalesce(before, 0) >= (SELECT 2 * max(round(value * 100)) FROM events)
""")
def chunk_cache(spark, sf_dir):
    """What a cache of chunks drops that is trimmed to twice the largest"""
    rows = _events(spark, sf_dir).select(F.col("snapshot_id").alias("name"), "time_us", F.round(F.col("value") * 100).alias("size"))
    return cache.trim(rows, "size", [F.desc("time_us"), F.desc("name")]).select("name", "size")


@query("""
SELECT CAST(floor(before / 1000) AS BIGINT) AS bin, count(*) AS blobs, CAST(sum(n) AS BIGINT) AS bytes FROM (
  SELECT n, coalesce(sum(n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT CAST(l_quantity AS BIGINT) AS n, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS k FROM lineitem)) GROUP BY 1
""")
def pack_binning(spark, sf_dir):
    """Bins by running size"""
    items = table(spark, sf_dir, "lineitem").withColumn("n", F.col("l_quantity").cast("long"))
    order = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")]
    return packs.bins(items, "n", 1000, order).groupBy("bin").agg(F.count(F.lit(1)).alias("blobs"), F.sum("n").alias("bytes"))


@query("""
WITH RECURSIVE blobs AS (
  SELECT sha256(text) AS blob_id, max(CAST(strlen(text) AS BIGINT)) AS n, CAST('0x' || substr(sha256(text), 1, 2) AS INT) % 4 AS lane FROM documents GROUP BY 1
), numbered AS (SELECT lane, n, row_number() OVER (PARTITION BY lane ORDER BY blob_id) AS k FROM blobs),
filling AS (
  SELECT lane, k, n, 0 AS pack_no, n AS filled FROM numbered WHERE k = 1
  UNION ALL
  SELECT b.lane, b.k, b.n, CASE WHEN f.filled >= 200000 THEN f.pack_no + 1 ELSE f.pack_no END, CASE WHEN f.filled >= 200000 THEN b.n ELSE f.filled + b.n END
  FROM filling f JOIN numbered b ON b.lane = f.lane AND b.k = f.k + 1
)
SELECT lane, pack_no, count(*) AS blobs, CAST(sum(n) AS BIGINT) AS bytes FROM filling GROUP BY 1, 2
""")
def pack_filling(spark, sf_dir):
    """Packs that close when full, in four lanes"""
    blobs = content_hash(spark, sf_dir).dropDuplicates(["blob_id"])
    lane = F.conv(F.left("blob_id", F.lit(2)), 16, 10).cast("int") % 4
    return packs.pack_up(blobs, 200_000, 4, lane=lane).groupBy("lane", "pack_no").agg(F.count(F.lit(1)).alias("blobs"), F.sum("length").alias("bytes"))


# -- files: changed, skipped, copied, restored


@query(f"""
WITH {_FILES},
f AS (SELECT snap, path, strlen(body) AS size, snap * (doc_id % 2) AS mtime FROM files)
SELECT b.path, a.path IS NULL OR a.size <> b.size OR a.mtime <> b.mtime AS changed FROM (SELECT * FROM f WHERE snap = 2) b LEFT JOIN (SELECT * FROM f WHERE snap = 1) a ON a.path = b.path
""")
def changed_files(spark, sf_dir):
    """Files to read again"""
    files = _files(spark, sf_dir).select(
        "snap",
        "path",
        F.lit("file").alias("kind"),
        F.octet_length("body").cast("long").alias("size"),
        (F.col("snap") * (F.col("doc_id") % 2)).alias("mtime_ns"),
        F.lit(None).cast("string").alias("chunks"),
    )
    return filters.with_previous(files.where("snap = 2"), files.where("snap = 1")).select("path", "changed")


_KEPT = "NOT regexp_matches(lang, 'd') AND NOT regexp_matches(lang || '/' || source, 'src1$') AND NOT regexp_matches(lang || '/' || source || '/' || doc_id, 'd|src1$')"


@query(f"SELECT doc_id FROM documents WHERE {_KEPT}")
def skip_filter(spark, sf_dir):
    """F1 F2: patterns tried on every ancestor"""
    named = table(spark, sf_dir, "documents").select("doc_id", _path().alias("path"))
    return filters.keep_unskipped(named, filters.merge_skips(["d"], ["src1$", "d"])).select("doc_id")


@query(f"""
WITH kept AS (SELECT lang, source, string_agg(doc_id || '=' || sha256(text), ',' ORDER BY doc_id || '=' || sha256(text)) AS body FROM documents WHERE {_KEPT} GROUP BY 1, 2)
SELECT lang, sha256(string_agg(source || '=' || sha256(body), ',' ORDER BY source || '=' || sha256(body))) AS tree_id FROM kept GROUP BY 1
""")
def filter_snapshot(spark, sf_dir):
    """Trees without what is skipped"""
    kept = filters.keep_unskipped(table(spark, sf_dir, "documents").withColumn("path", _path()), ["d", "src1$"])
    leaf = kept.select("lang", "source", F.concat_ws("=", "doc_id", ids.digest(F.col("text"), 256)).alias("e"))
    combine = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ","), 256)
    below = leaf.groupBy("lang", "source").agg(combine(F.col("e")).alias("h"))
    return below.groupBy("lang").agg(combine(F.concat_ws("=", "source", "h")).alias("tree_id"))


@query(f"""
WITH {_FILES}, held AS (SELECT sha256(text) AS h FROM documents WHERE doc_id % 4 = 0)
SELECT DISTINCT sha256(body) AS blob_id, CAST(strlen(body) AS BIGINT) AS length FROM files WHERE snap IN (0, 2) AND NOT regexp_matches(path, '^de') AND sha256(body) NOT IN (SELECT h FROM held)
""")
def copy_plan(spark, sf_dir):
    """Blobs that a copy of two snapshots must bring"""
    refs = filters.keep_unskipped(_refs(spark, sf_dir).where("snap in (0, 2)"), ["^de"])
    held = content_hash(spark, sf_dir).where("doc_id % 4 = 0")
    return dedup.new_blobs(refs, held).select("blob_id", "length")


@query(f"""
WITH {_FILES},
f AS (SELECT snap, path, sha256(body) AS h FROM files),
j AS (SELECT coalesce(a.path, b.path) AS path, a.h AS ah, b.h AS bh FROM (SELECT * FROM f WHERE snap = 1) a FULL OUTER JOIN (SELECT * FROM f WHERE snap = 2) b ON a.path = b.path)
SELECT deleting, 'out/' || array_to_string(string_split(path, '/')[2:], '/') AS place, path, CASE WHEN ah IS NULL THEN '+' WHEN bh IS NULL THEN '-' ELSE 'C' END AS code
FROM j, (VALUES (true), (false)) d(deleting) WHERE (ah IS NULL OR bh IS NULL OR ah <> bh) AND (bh IS NOT NULL OR deleting)
""")
def restore_plan(spark, sf_dir):
    """Actions with and without removal, and where they go"""
    files = _refs(spark, sf_dir).select(
        "snap", "path", "parts", F.lit("file").alias("kind"), F.col("blob_id").alias("chunks"), F.lit(None).cast("string").alias("target"),
    )
    old, new = files.where("snap = 1").drop("snap"), files.where("snap = 2").drop("snap")
    out = None
    for delete in (True, False):
        actions = restore.plan(old, new, ["path"], delete).select(
            F.lit(delete).alias("deleting"), restore.remap(paths.parts(F.col("path")), F.lit("out")).alias("place"), "path", "code",
        )
        out = actions if out is None else out.unionByName(actions)
    return out


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS content FROM conversations GROUP BY conv_id")
def reassemble_file(spark, sf_dir):
    """K9: contents from ordered chunks"""
    return restore.reassemble(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text")


@query("""
SELECT l_orderkey, '{"type":"chunk","length":' || CAST(l_quantity AS BIGINT) || ',"id":' || l_partkey || '}' AS json FROM lineitem
""")
def cat_json(spark, sf_dir):
    """Rows as JSON"""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.to_json(F.struct(F.lit("chunk").alias("type"), F.col("l_quantity").cast("long").alias("length"), F.col("l_partkey").alias("id"))).alias("json"),
    )


@query("""
SELECT sha256(text) AS blob_id FROM documents WHERE doc_id % 3 = 1 EXCEPT
(SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0 UNION SELECT sha256(text) FROM documents WHERE doc_id % 7 = 0)
""")
def restart_filter(spark, sf_dir):
    """What a restarted run still has to store, given stored and half-written blobs"""
    hashed = content_hash(spark, sf_dir)
    wip = hashed.where("doc_id % 7 = 0").select("blob_id")
    return dedup.new_blobs(hashed.where("doc_id % 3 = 1"), hashed.where("doc_id % 3 = 0").select("blob_id").union(wip)).select("blob_id")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, sf_dir):
    """A stream's distinct keys, by stateful dedup"""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    folder = scratch.folder(spark, "stream")
    distinct = ingest.distinct_stream(stream.select("user_id", "event_type"), ["user_id", "event_type"])
    run = distinct.writeStream.format("parquet").option("path", f"{folder}/out").option(
        "checkpointLocation", f"{folder}/check",
    ).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(distinct.schema).parquet(f"{folder}/out")


@query("SELECT count(*) AS rows, count(DISTINCT user_id) AS users FROM events")
def stream_progress(spark, sf_dir):
    """Rows that a stream took in by its own reports, and what it wrote"""
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    folder = scratch.folder(spark, "stream")
    users = ingest.distinct_stream(stream.select("user_id"), ["user_id"])
    run = users.writeStream.format("parquet").option("path", f"{folder}/out").option(
        "checkpointLocation", f"{folder}/check",
    ).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    written = spark.read.schema(users.schema).parquet(f"{folder}/out")
    return written.agg(F.lit(progress.rows_read(run)).cast("long").alias("rows"), F.count(F.lit(1)).alias("users"))


@query("""
WITH blobs AS (SELECT DISTINCT sha256(text) AS blob_id, CAST(strlen(text) AS BIGINT) AS n FROM documents)
SELECT 'read' AS name, 'rows' AS measure, count(*) AS value FROM documents UNION ALL SELECT 'read', 'bytes', CAST(sum(strlen(text)) AS BIGINT) FROM documents
UNION ALL SELECT 'kept', 'rows', count(*) FROM blobs UNION ALL SELECT 'kept', 'bytes', CAST(sum(n) AS BIGINT) FROM blobs
""")
def run_counters(spark, sf_dir):
    """What a dedup run read and kept, counted as it runs"""
    counters = progress.Counters()
    size = F.sum("length")
    read = counters.watch(content_hash(spark, sf_dir), "read", bytes=size)
    kept = counters.watch(read.dropDuplicates(["blob_id"]).select("blob_id", "length"), "kept", bytes=size)
    scratch.free(scratch.materialize(kept, "counted"))
    return counters.table(spark)


# -- functions on text, sizes and times


@query("""
SELECT doc_id, CASE WHEN n < 1000 THEN n || ' B' WHEN n < 1000000 THEN CAST(round(n / 1000.0) AS BIGINT) || ' KB'
  WHEN n < 1000000000 THEN printf('%.2f', n / 1e6) || ' MB' ELSE printf('%.2f', n / 1e9) || ' GB' END AS size
FROM (SELECT doc_id, strlen(text) * (1 + doc_id % 4 * 777777) AS n FROM documents)
""")
def human_size(spark, sf_dir):
    """Sizes for people"""
    n = F.octet_length("text").cast("long") * (1 + F.col("doc_id") % 4 * 777777)
    return table(spark, sf_dir, "documents").select("doc_id", sizes.human_size(n).alias("size"))


@query("""
SELECT page_id, parts[-1] AS last, ends_with(url, '/') AS slash, len(parts) AS depth
FROM (SELECT *, list_filter(string_split(regexp_replace(url, '^https?://', ''), '/'), lambda x: x <> '') AS parts FROM pages)
""")
def path_functions(spark, sf_dir):
    """Components of paths"""
    path = F.regexp_replace("url", "^https?://", "")
    found = [
        paths.last_component(path).alias("last"), paths.has_trailing_slash(F.col("url")).alias("slash"), F.size(paths.parts(path)).cast("long").alias("depth"),
    ]
    return table(spark, sf_dir, "pages").select("page_id", *found)


@query("""
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST(CAST(epoch_us(ts) % 1000000 AS BIGINT) * 1000 + 7 AS VARCHAR), 9, '0') || 'Z' AS moment,
       epoch_us(ts) * 1000 + 7 AS ns, strftime(ts, '%a %b %-d %Y %H:%M:%S') AS shown, CASE WHEN event_id % 3 > 0 THEN CAST(epoch_us(ts) * 1000 AS VARCHAR) ELSE 'none' END AS file_time FROM events
""")
def time_text(spark, sf_dir):
    """Nanoseconds as text, and back; for people; and from counts of 100 ns since 1601, where 0 is none"""
    ns = _moment() * 1000 + 7
    text = times.to_text(ns)
    ticks = F.when(F.col("event_id") % 3 > 0, (_moment() + 11_644_473_600_000_000) * 10).otherwise(0)
    events = table(spark, sf_dir, "events")
    return events.select(
        "event_id",
        text.alias("moment"),
        times.parse(text).alias("ns"),
        times.display(ns).alias("shown"),
        F.coalesce(times.from_filetime(ticks).cast("string"), F.lit("none")).alias("file_time"),
    )


@query("SELECT lang AS prefix, count(*) AS objects, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents WHERE source <> 'src3' GROUP BY 1")
def list_by_prefix(spark, sf_dir):
    """Totals by prefix, temporaries left out"""
    from ..sources.objects import totals_by_prefix

    name = F.concat(_path(), F.when(F.col("source") == "src3", ".part").otherwise(".pack"))
    listed = table(spark, sf_dir, "documents").select(name.alias("name"), F.col("lang").alias("prefix"), F.octet_length("text").cast("long").alias("bytes"))
    return totals_by_prefix(filters.finished_objects(listed))


@query("SELECT doc_id, starts_with(text, 'The') AS magic FROM documents")
def magic_check(spark, sf_dir):
    """F16: leading bytes"""
    return table(spark, sf_dir, "documents").select("doc_id", filters.has_magic(F.col("text").cast("binary"), b"The").alias("magic"))


@query(f"WITH {_FILES} SELECT max(length(path)) AS width FROM files WHERE snap < 2")
def path_width(spark, sf_dir):
    """The widest path"""
    return _files(spark, sf_dir).where("snap < 2").agg(F.max(F.char_length("path")).cast("long").alias("width"))


@query("SELECT source || '/' || lang AS name, count(*) AS roots FROM documents GROUP BY source, lang HAVING count(*) > 1")
def clashing_roots(spark, sf_dir):
    """last components that several roots share"""
    rows = table(spark, sf_dir, "documents").select(F.concat_ws("/", "doc_id", F.concat_ws("|", "source", "lang")).alias("path"))
    return snapshots.clashing_roots(rows).select(F.replace("name", F.lit("|"), F.lit("/")).alias("name"), "roots")


@query(f"""
WITH {_FILES},
refs AS (SELECT snap, path, strlen(body) AS n, row_number() OVER (PARTITION BY sha256(body) ORDER BY snap, string_split(path, '/')) AS r FROM files),
f AS (SELECT snap, path, sha256(body) AS h FROM files),
j AS (SELECT b.path, CASE WHEN a.h IS NULL THEN '+' ELSE 'C' END AS code FROM (SELECT * FROM f WHERE snap = 2) b LEFT JOIN (SELECT * FROM f WHERE snap = 1) a ON a.path = b.path WHERE a.h IS NULL OR a.h <> b.h)
SELECT j.path, j.code, CAST(sum(CASE WHEN r = 1 THEN n ELSE 0 END) AS BIGINT) AS introduced FROM j JOIN refs ON refs.path = j.path AND refs.snap = 2 GROUP BY 1, 2
""")
def stat_with_sizes(spark, sf_dir):
    """A comparison's lines with the bytes they introduced"""
    refs = _refs(spark, sf_dir)
    entries = refs.select("snap", "path", F.lit("file").alias("kind"), F.col("blob_id").alias("chunks"), F.lit(None).cast("string").alias("target"))
    changes = diff.compare(entries.where("snap = 1").drop("snap"), entries.where("snap = 2").drop("snap"), ["path"]).where("code <> '-'")
    found = dedup.introduced(refs, "blob_id", "length", [F.col("snap"), F.col("parts")], ["snap", "path"]).where("snap = 2")
    return changes.join(found, "path", "left").select("path", "code", "introduced")
