"""Queries that run the commands on a file tree made of the driver's tables, with the SQL that gives the same rows.

The tree has a folder for each region with a file for each nation, holding lines on it. A second snapshot lacks Asia,
has other contents in the files whose nation's key is even, and an empty folder more. The tree and its repository lie in the
scratch folder, which must be one of this machine's, as the commands read file systems.
"""

from __future__ import annotations

import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..scratch import folder, materialize, scratch_dir
from ..sources import filesystem, memory, objects
from ..sources.repository import Repository
from ..sources.tables import table
from . import commands
from .queries import query

#: Scratch folder and tables: the folder with the tree and its repository, made once.
_MADE: dict[tuple[str, str], str] = {}


def _files(spark: SparkSession, sf_dir: str) -> list[tuple[str, str, int, str]]:
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    body = F.repeat(F.concat("n_name", F.lit(" in "), "r_name", F.lit("\n")), F.col("n_nationkey").cast("int") + 3)
    return [tuple(r) for r in rows.select("r_name", "n_name", "n_nationkey", body).collect()]  # 25 rows


def _work(spark: SparkSession, sf_dir: str) -> str:
    """A folder with ``src`` and ``repo``, which holds two snapshots of it."""
    key = scratch_dir(spark), sf_dir
    if key in _MADE and os.path.isdir(_MADE[key]):
        return _MADE[key]
    work = folder(spark, "scenario")
    if "://" in work and not work.startswith("file://"):
        raise OSError(f"{work} is on no file system of this machine")
    work = work.removeprefix("file://").removeprefix("file:")
    for region, nation, _, body in _files(spark, sf_dir):
        os.makedirs(f"{work}/src/{region}", exist_ok=True)
        with open(f"{work}/src/{region}/{nation}.txt", "w", encoding="utf-8") as f:
            f.write(body)
    repo = commands.init(spark, f"{work}/repo")
    commands.backup(repo, [f"{work}/src"], author="one", tags=["b", "a"], time_ns=1_000)
    shutil.rmtree(f"{work}/src/ASIA")
    os.mkdir(f"{work}/src/NOWHERE")
    for region, nation, number, body in _files(spark, sf_dir):
        if region != "ASIA" and number % 2 == 0:
            with open(f"{work}/src/{region}/{nation}.txt", "w", encoding="utf-8") as f:
                f.write(body + " again")
    commands.backup(repo, [f"{work}/src"], author="two", time_ns=2_000)
    _MADE[key] = work
    return work


def _repo(spark: SparkSession, sf_dir: str) -> Repository:
    return Repository(spark, f"{_work(spark, sf_dir)}/repo")


def _own(spark: SparkSession, sf_dir: str) -> tuple[str, Repository]:
    """A folder of the query's own with a copy of the repository, for commands that change it."""
    work = _work(spark, sf_dir)
    own = f"{work}/own-{uuid.uuid4().hex}"
    shutil.copytree(f"{work}/repo", f"{own}/repo")
    return own, Repository(spark, f"{own}/repo")


_TREE = """
nations AS (SELECT *, repeat(n_name || ' in ' || r_name || chr(10), CAST(n_nationkey + 3 AS INT)) AS body FROM nation JOIN region ON n_regionkey = r_regionkey),
files AS (
  SELECT snap, r_name AS folder, n_name || '.txt' AS name, CASE WHEN snap = 2 AND n_nationkey % 2 = 0 THEN body || ' again' ELSE body END AS body
  FROM nations, (SELECT unnest([1, 2]) AS snap) WHERE snap = 1 OR r_name <> 'ASIA'
), folders AS (SELECT DISTINCT snap, folder FROM files UNION ALL SELECT 2, 'NOWHERE')
"""
_LIST = "SELECT 'src/' AS line UNION ALL SELECT 'src/' || folder || '/' FROM folders WHERE snap = {0} UNION ALL SELECT 'src/' || folder || '/' || name FROM files WHERE snap = {0}"


@query(f"WITH {_TREE} {_LIST.format(2)}")
def command_ls(spark, sf_dir):
    """A tree is walked, backed up and listed"""
    return commands.ls(_repo(spark, sf_dir), "LAST").select("line")


@query(f"""
WITH {_TREE}, a AS (SELECT * FROM files WHERE snap = 1), b AS (SELECT * FROM files WHERE snap = 2)
SELECT '- src/ASIA/' AS line UNION ALL SELECT '+ src/NOWHERE/' UNION ALL
SELECT CASE WHEN b.name IS NULL THEN '- src/' ELSE 'C src/' END || a.folder || '/' || a.name FROM a LEFT JOIN b ON a.folder = b.folder AND a.name = b.name
WHERE b.name IS NULL OR a.body <> b.body
""")
def command_diff(spark, sf_dir):
    """J4 J5 of stored snapshots: what the second changed"""
    return commands.diff_snapshots(_repo(spark, sf_dir), "LAST~", "LAST").select("line")


@query(f"WITH {_TREE} SELECT 'src/' || folder || '/' || name AS path, CAST(strlen(body) AS BIGINT) AS size, sha256(body) AS digest FROM files WHERE snap = 1")
def command_restore(spark, sf_dir):
    """The first snapshot restored to a new place, walked and read"""
    own = f"{_work(spark, sf_dir)}/restored-{uuid.uuid4().hex}/src"
    commands.restore_snapshot(_repo(spark, sf_dir), "LAST~", own, times=True, permissions=True)
    walked = filesystem.scan(spark, [own]).where("kind = 'file'").select("path", "full_path", "size")
    read = objects.read_objects(spark, f"file://{own}", "*.txt").select(
        F.regexp_replace("path", "^file:/+", "/").alias("full_path"), ids.digest(F.col("content"), 256).alias("digest"),
    )
    return walked.join(read, "full_path").select("path", "size", "digest")


@query(f"WITH {_TREE} SELECT name || ': ' || body AS line FROM files WHERE snap = 2 AND folder = 'EUROPE'")
def command_dump(spark, sf_dir):
    """files' contents by path"""
    repo = _repo(spark, sf_dir)
    names = [r["line"] for r in commands.dump(repo, "LAST", "src/EUROPE").collect()]  # one folder
    out = None
    for name in names:
        line = commands.dump(repo, "LAST", f"src/EUROPE/{name}").select(F.concat(F.lit(f"{name}: "), F.col("content").cast("string")).alias("line"))
        out = line if out is None else out.unionByName(line)
    return out


@query(f"WITH {_TREE} SELECT * FROM ({_LIST.format(2)}) WHERE NOT starts_with(line, 'src/AFRICA')")
def command_filter_snapshot(spark, sf_dir):
    """A snapshot without a folder, listed"""
    _, repo = _own(spark, sf_dir)
    return commands.ls(repo, commands.filter_snapshot(repo, "LAST", ["/AFRICA$"], time_ns=3_000)).select("line")


@query(f"WITH {_TREE} {_LIST.format(1)}")
def command_copy(spark, sf_dir):
    """The first snapshot copied to another repository, listed there"""
    own, repo = _own(spark, sf_dir)
    other = commands.init(spark, f"{own}/other")
    commands.copy(repo, other, ["LAST~"])
    return commands.ls(other, "LAST").select("line")


@query("""
SELECT * FROM (VALUES (1000, 'one', 'a,b', 'src'), (2000, 'two', '', 'src')) AS t(time_ns, author, tags, "root")
""")
def command_snapshots(spark, sf_dir):
    """Snapshots as stored, in order of time"""
    rows = commands.list_snapshots(_repo(spark, sf_dir))
    return rows.select("time_ns", "author", F.array_join("tags", ",").alias("tags"), F.regexp_extract(F.element_at("paths", 1), "([^/]+)$", 1).alias("root"))


@query(f"""
WITH {_TREE}, blobs AS (SELECT body, strlen(body) AS n, count(*) AS visits, bool_or(snap = 2) AS live FROM files GROUP BY body)
SELECT 'all' AS which, count(*) AS chunks, CAST(sum(n) AS BIGINT) AS bytes, CAST(sum(n * (visits - 1)) AS BIGINT) AS reused FROM blobs
UNION ALL SELECT 'pruned', count(*), CAST(sum(n) AS BIGINT), CAST(sum(n * (visits2 - 1)) AS BIGINT) FROM (SELECT body, strlen(body) AS n, count(*) AS visits2 FROM files WHERE snap = 2 GROUP BY body)
""")
def command_prune(spark, sf_dir):
    """S8 K3 A6 and the commands forget, prune, check: chunks stored and reused, with both snapshots and after the first is gone"""
    _, repo = _own(spark, sf_dir)

    def stored(which: str) -> DataFrame:
        chunks = repo.manifest().where("blob_type = 'chunk'").select("blob_id", "length")
        met = commands.visited(repo).select("blob_id", "visits")
        sums = [F.count(F.lit(1)).alias("chunks"), F.sum("length").alias("bytes"), F.sum(F.col("length") * (F.col("visits") - 1)).cast("long").alias("reused")]
        return materialize(chunks.join(met, "blob_id").agg(*sums).select(F.lit(which).alias("which"), "chunks", "bytes", "reused"), "stored")

    before = stored("all")
    commands.forget(repo, ["LAST~"])
    commands.prune(repo)
    if not commands.check(repo, read_packs=True)["ok"]:
        raise AssertionError("the pruned repository is broken")
    return before.unionByName(stored("pruned"))


@query(f"WITH {_TREE} SELECT DISTINCT strlen(body) AS length, sha256(body) AS digest FROM files")
def command_rebuild_index(spark, sf_dir):
    """S10 S11 S17 F17 and rebuild-index: the chunks that a new index of all packs names, read"""
    _, repo = _own(spark, sf_dir)
    if commands.rebuild_index(repo) not in repo.index_names():
        raise AssertionError("the new index is not there")
    named = repo.manifest().where("blob_type = 'chunk'").select("pack_id", "blob_id")
    read = repo.contents(repo.blobs().where("kind = 'chunk'").select("pack_id", "blob_id", "bytes")).join(named, ["pack_id", "blob_id"])
    return read.select(F.octet_length("bytes").cast("long").alias("length"), ids.digest(F.col("bytes"), 256).alias("digest"))


@query(f"WITH {_TREE} SELECT 'tree' AS kind, folder || '/' || name AS entry FROM files WHERE snap = 2 UNION ALL SELECT 'tree', folder || '/' FROM folders WHERE snap = 2")
def command_cat(spark, sf_dir):
    """Trees decoded from their blobs, as the folders below the root hold them"""
    repo = _repo(spark, sf_dir)
    root = commands.snapshot_root(repo, "LAST")
    decoded = commands.decoded_trees(repo)
    top = decoded.where(F.col("tree_id") == root).select(F.col("subtree").alias("tree_id"))
    folders = materialize(decoded.join(top, "tree_id").select("subtree", F.col("name").alias("folder")), "folders")
    below = decoded.select(F.col("tree_id").alias("subtree"), "name").join(folders, "subtree").select(F.concat_ws("/", "folder", "name").alias("entry"))
    return below.unionByName(folders.select(F.concat("folder", F.lit("/")).alias("entry"))).select(F.lit("tree").alias("kind"), "entry")


@query(f"WITH {_TREE} SELECT name, CAST(strlen(body) AS BIGINT) AS length, body AS text FROM files WHERE snap = 1")
def memory_objects(spark, sf_dir):
    """Objects kept in memory, written, listed and read"""
    store = memory.MemoryStore(spark)
    for _, nation, _, body in _files(spark, sf_dir):
        store.write(f"{nation}.txt", body.encode())
    store.write("left over.part", b"")
    store.write("GONE", b"x")
    store.remove("GONE")
    return store.objects().select("name", "length", F.col("content").cast("string").alias("text"))
