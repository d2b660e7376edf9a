"""Copies of stored tables by content: only files that differ are sent, and a torn copy is seen.

A table's tree of hashes has four levels: blocks of 4 MiB, files (the hash of their blocks' hashes), ranges, the table.
Tasks read blocks by themselves, so a file of any size is hashed in parallel with a block in memory. Files never change
once a commit names them, so their hashes are kept under ``<root>/trees`` by commit and only new files are hashed.

``replicate`` compares the roots of both sides with that of their last copy (logged on both sides under ``<root>/synced``)
and stops where both have changed. Each file is written beside its name, renamed when it is whole, and read again: what
doesn't have its hash is an error, and nothing is committed. A run that was cut off leaves no commit; the next one hashes
what it finds and sends the rest. The copy's commit fails if another writer's was first, as every commit does.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators.ingest import transfer_decision
from quillspan.sources.commits import Commits, Conflict
from quillspan.sources.files import exists, numbered, opened, settle
from quillspan.sources.ranges import RangeTable

BLOCK = 4 << 20  # bytes
TREE = "range_ int, file string, length long, hash string"
_FILE = r"(v[0-9]+-[0-9a-f]+/rows/range_=([0-9]+)/[^/]+)$"  # as RangeTable names them, below its root


def _tasks(blocks: int) -> int:
    return max(1, min(blocks, 32 + blocks // 64))


def block_hashes(files: DataFrame, block: int = BLOCK) -> DataFrame:
    """file, block, digest (hex SHA-256) of every block of files (path, length); columns besides them are kept out."""
    n = F.ceil(F.col("length") / block).cast("long")
    total = files.agg(F.sum(n)).first()[0] or 0
    blocks = files.filter("length > 0").select("path", F.explode(F.sequence(F.lit(0), n - 1)).alias("block"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, at in zip(*(batch.column(c).to_pylist() for c in ("path", "block"))):
                system, name = opened(path)
                with system.open_input_file(name) as f:
                    out.append(hashlib.sha256(f.read_at(block, at * block)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("block"), pa.array(out, pa.string())], names=["path", "block", "digest"])

    # rows are few and heavy: a stated number of tasks, which adaptive plans leave as it is
    return blocks.repartition(_tasks(total), "path", "block").mapInArrow(digest, "path string, block long, digest string")


def file_hashes(files: DataFrame, block: int = BLOCK) -> DataFrame:
    """files (path, length and what else they have) with hash: SHA-256 over their blocks' SHA-256; 32 bytes a block meet."""
    digests = F.transform(F.sort_array(F.collect_list(F.struct("block", "digest"))), lambda b: b["digest"])
    whole = block_hashes(files, block).groupBy("path").agg(F.sha2(F.unhex(F.array_join(digests, "")), 256).alias("hash"))
    return files.join(whole, "path")


def listed(spark: SparkSession, folders: list[str]) -> DataFrame:
    """path and length of the files in folders; those that aren't there have none. No file is opened; empty ones are passed over."""
    there = [p for p in folders if exists(spark, p)]
    if not there:
        return spark.createDataFrame([], "path string, length long")
    return spark.read.format("binaryFile").load(there).select("path", "length")


def _files(table: RangeTable, ranges: dict[str, str]) -> DataFrame:
    """range_, file (below the root), length and path of what lies in folders that a manifest names."""
    rows = listed(table.spark, [f"{table.root}/{p}" for p in ranges.values()])
    return rows.select(F.regexp_extract("path", _FILE, 2).cast("int").alias("range_"), F.regexp_extract("path", _FILE, 1).alias("file"), "length", "path").filter("file <> ''")


def tree(table: RangeTable, at: int | None = None, block: int = BLOCK) -> DataFrame:
    """``TREE`` rows of a commit (the last by default), made once and kept; files of an earlier kept tree aren't read again."""
    spark = table.spark
    n = table.version() if at is None else at
    folder = f"{table.root}/trees"
    kept = numbered(spark, folder)
    if n < 0:
        return spark.createDataFrame([], TREE)
    if n not in kept:
        files = _files(table, table.commits.read(n).get("ranges", {}))
        known = spark.read.schema(TREE).parquet(f"{folder}/{max(kept)}") if kept else spark.createDataFrame([], TREE)
        old = files.join(known.select("file", "length", "hash"), ["file", "length"], "left_outer")
        new = file_hashes(old.filter("hash is null").drop("hash"), block)
        _keep(table, n, old.filter("hash is not null").select(*_columns()).unionByName(new.select(*_columns())))
    return spark.read.schema(TREE).parquet(f"{folder}/{n}")


def _columns() -> list[str]:
    return ["range_", "file", "length", "hash"]


def _keep(table: RangeTable, n: int, rows: DataFrame) -> None:
    """Keep a commit's tree; of older ones the last stays, for those who read it."""
    aside = f"{table.root}/.tree-{uuid.uuid4().hex}"
    rows.repartition(_tasks(rows.sparkSession.sparkContext.defaultParallelism)).write.parquet(aside)
    settle(table.spark, aside, f"{table.root}/trees/{n}")
    for old in numbered(table.spark, f"{table.root}/trees")[:-2]:
        table.commits.delete(f"{table.root}/trees/{old}")


def range_hashes(rows: DataFrame) -> DataFrame:
    """range_ and hash of a tree's ranges: over their files' names and hashes."""
    names = F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "file", "hash"))), "\n")
    return rows.groupBy("range_").agg(F.sha2(names, 256).alias("hash"))


def root_hash(rows: DataFrame) -> str:
    """A tree's root, over its ranges, which are as many as a manifest names."""
    joined = F.array_join(F.sort_array(F.collect_list(F.struct("range_", F.concat_ws(":", F.col("range_").cast("string"), "hash").alias("s")))).getField("s"), "\n")
    return range_hashes(rows).agg(F.sha2(F.coalesce(joined, F.lit("")), 256)).first()[0]


def differences(source: DataFrame, target: DataFrame) -> DataFrame:
    """Rows of the source's tree that the target lacks, or has with other content; only ranges that differ are gone into."""
    other = range_hashes(source).join(range_hashes(target), ["range_", "hash"], "left_anti").select("range_")
    return source.join(F.broadcast(other), "range_", "left_semi").join(target, ["file", "hash"], "left_anti").select(*_columns())  # numbers of a manifest's ranges


def damaged(table: RangeTable, block: int = BLOCK) -> DataFrame:
    """file and problem (missing, length, content) of the last commit's files that aren't what its kept tree says: all are read."""
    want = tree(table, block=block)
    now = file_hashes(_files(table, table.commits.head()[1].get("ranges", {})), block)
    both = want.alias("w").join(now.alias("n"), F.col("w.file") == F.col("n.file"), "left")
    problem = F.when(F.col("n.file").isNull(), "missing").when(F.col("w.length") != F.col("n.length"), "length").when(F.col("w.hash") != F.col("n.hash"), "content")
    return both.select("w.file", problem.alias("problem")).filter("problem is not null")


def _send(files: DataFrame, source: str, target: str, n: int, block: int) -> DataFrame:
    """Copy files (file) from one root to another, a file a task and a block at a time; file and length of each."""

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, lengths = batch.column("file").to_pylist(), []
            for name in names:
                (a, from_), (b, to) = opened(f"{source}/{name}"), opened(f"{target}/{name}")
                folder, last = to.rsplit("/", 1)
                b.create_dir(folder, recursive=True)
                aside, done = f"{folder}/.{last}.{uuid.uuid4().hex}", 0  # another attempt at this task has its own
                with a.open_input_stream(from_) as r, b.open_output_stream(aside) as w:
                    while part := r.read(block):
                        w.write(part)
                        done += len(part)
                b.move(aside, to)
                lengths.append(done)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(lengths, pa.int64())], names=["file", "length"])

    return files.select("file").repartition(_tasks(n), "file").mapInArrow(copy, "file string, length long")


def last_synced(a: RangeTable, b: RangeTable) -> str | None:
    """The root that both sides had after their last copy, either way; None if there was none."""
    logs = [{r["hash"]: n for n in log.numbers() if (r := log.read(n))["with"] == other} for log, other in ((_log(a), b.root), (_log(b), a.root))]
    both = set(logs[0]) & set(logs[1])
    return max(both, key=lambda h: logs[0][h]) if both else None


def _log(table: RangeTable) -> Commits:
    return Commits(table.spark, f"{table.root}/synced")


def _remember(table: RangeTable, other: RangeTable, root: str) -> None:
    log = _log(table)
    while True:
        try:
            return log.commit(log.head()[0] + 1, {"with": other.root, "hash": root})
        except Conflict:
            continue


def status(source: RangeTable, target: RangeTable, block: int = BLOCK) -> dict:
    """Both roots, that of the last copy, and what ``replicate`` would do: decision, files and bytes to send."""
    s, t = tree(source, block=block), tree(target, block=block)
    roots = [root_hash(x) if table.version() >= 0 else None for x, table in ((s, source), (t, target))]
    synced = last_synced(source, target)
    row = source.spark.createDataFrame([(*roots, synced)], "s string, t string, y string")
    d = row.select(transfer_decision(F.col("s"), F.col("t"), F.col("y")).alias("d")).first()["d"]
    what = differences(s, t).agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    return {"source": roots[0], "target": roots[1], "synced": synced, "decision": d, "files": what["files"], "bytes": what["bytes"]}


def replicate(source: RangeTable, target: RangeTable, force: bool = False, block: int = BLOCK) -> dict:
    """Make the target's table the source's where the decision is to proceed (or ``force``); ``status`` with what was sent.

    Files that a run before left at the target count if they have their hash. The feed of changes goes along where the
    target's last commit is a copy of one of the source's.
    """
    spark = source.spark
    n, head = source.commits.head()
    m, there = target.commits.head()
    said = status(source, target, block)
    if said["decision"] == "up_to_date" and n >= 0:
        if said["synced"] != said["source"]:
            _remember(source, target, said["source"])
            _remember(target, source, said["source"])
        return said | {"files": 0, "bytes": 0}
    if n < 0 or (said["decision"] != "proceed" and not force):
        return said | {"files": 0, "bytes": 0}
    s, ranges = tree(source, n, block), head.get("ranges", {})
    known = tree(target, m, block)
    found = _files(target, ranges)
    sure = found.join(known.select("file", "length", "hash"), ["file", "length"], "left")
    have = sure.filter("hash is not null").select(*_columns()).unionByName(file_hashes(sure.filter("hash is null").drop("hash"), block).select(*_columns()))
    plan = f"{target.root}/.sending-{uuid.uuid4().hex}"
    differences(s, have).write.parquet(plan)
    todo = spark.read.schema(TREE).parquet(plan)
    count = todo.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    try:
        _send(todo, source.root, target.root, count["files"], block).write.format("noop").mode("overwrite").save()
        sent = file_hashes(_files(target, ranges).join(todo.select("file"), "file", "left_semi"), block)
        torn = todo.join(sent.select("file", "hash"), ["file", "hash"], "left_anti").first()
        if torn is not None:
            raise OSError(f"{target.root}/{torn['file']} isn't what was sent")
    finally:
        target.commits.delete(plan)
    content = {"bits": head.get("bits", 0), "ranges": ranges, "folder": head.get("folder"), "copy_of": n}
    since = there.get("copy_of")
    if since is not None and since <= n and since in source.commits.numbers():
        folder = f"v{m + 1:06d}-{uuid.uuid4().hex[:8]}"
        source.changes(since).write.parquet(f"{target.root}/{folder}/changes")
        content["changes"] = f"{folder}/changes"
    target.commits.commit(m + 1, content)
    _keep(target, m + 1, s)
    _remember(source, target, said["source"])
    _remember(target, source, said["source"])
    return said | {"files": count["files"], "bytes": count["bytes"]}
