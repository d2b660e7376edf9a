"""Files that tasks read and write by themselves, in parts: what Spark's own sources can't do with files as they are."""

from __future__ import annotations

import re
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import SparkSession


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark writes it (``/a``, ``file:/a``, ``hdfs://host/a``), and the path on it."""
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):(.*)", path)
    if scheme is None or scheme[1] == "file":
        return fs.LocalFileSystem(), re.sub(r"^/*", "/", path if scheme is None else scheme[2])
    return fs.FileSystem.from_uri(f"{scheme[1]}:{quote(scheme[2], safe='/:@=+,')}")


def settle(spark: SparkSession, aside: str, target: str, keep: bool = False) -> bool:
    """Rename a folder or file that is whole to its name; False where the name is taken, and unless ``keep`` it is deleted then."""
    jvm = spark._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    a, t = jvm.org.apache.hadoop.fs.Path(aside), jvm.org.apache.hadoop.fs.Path(target)
    files = t.getFileSystem(conf)
    files.mkdirs(t.getParent())
    if not files.exists(t):
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(t.toUri(), conf).rename(a, t, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except Exception:
            if not files.exists(t):
                raise
    if not keep:
        files.delete(a, True)
    return False


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def numbered(spark: SparkSession, folder: str) -> list[int]:
    """The numbers that name what lies in a folder, in order."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(p):
        return []
    return sorted(int(f.getPath().getName()) for f in files.listStatus(p) if f.getPath().getName().isdigit())
