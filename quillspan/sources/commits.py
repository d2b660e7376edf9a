"""Numbered commits of a table's manifest: the one who writes a number first has it, others learn of it.

A commit is a small JSON file under ``<root>/log``. It is written aside and renamed to its number, which fails where
the number is taken; readers see whole commits only. On file systems whose rename isn't atomic (object stores without
conditional writes) two writers at once need a lock of their own.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import SparkSession

_local: dict[str, str] = {}


class Conflict(RuntimeError):
    """Another writer's commit took the number."""


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder under the one that ``spark.checkpoint.dir`` names; under one of our own only where all runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = _local.setdefault("root", "file://" + tempfile.mkdtemp(prefix="quillspan-core-"))
    return f"{named.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


class Commits:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder = spark, f"{root.rstrip('/')}/log"

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        p, fs = self._fs(self.folder)
        if not fs.exists(p):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(p)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, n: int) -> dict:
        p, fs = self._fs(f"{self.folder}/{n:012d}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def head(self) -> tuple[int, dict]:
        """The last commit and its number; -1 before the first."""
        n = max(self.numbers(), default=-1)
        return n, self.read(n) if n >= 0 else {}

    def commit(self, n: int, content: dict) -> None:
        """Make ``content`` commit n; ``Conflict`` if there is one already."""
        jvm = self.spark._jvm
        target, fs = self._fs(f"{self.folder}/{n:012d}.json")
        aside, _ = self._fs(f"{self.folder}/.{n:012d}-{uuid.uuid4().hex}.tmp")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            files.rename(aside, target, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            fs.delete(aside, False)
            if fs.exists(target):
                raise Conflict(f"commit {n} of {self.folder} was made by another writer") from e
            raise

    def delete(self, path: str) -> None:
        p, fs = self._fs(path)
        fs.delete(p, True)
