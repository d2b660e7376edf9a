"""Intermediate tables in the folder that the cluster shares, and id filters of bounded size."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.batches import small_batches

_local_root: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; one of our own only where none is named and all runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "root" not in _local_root:
        _local_root["root"] = "file://" + tempfile.mkdtemp(prefix="quillspan-")
    return _local_root["root"]


class Scratch:
    """Parquet tables that cut lineage: they outlive lost executors and are read column by column."""

    def __init__(self, spark: SparkSession, tag: str):
        small_batches(spark)
        self.spark = spark
        self.root = f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame, name: str = "t", free: bool = False) -> DataFrame:
        """Write ``df`` and return the written table. free: what was shuffled for it is deleted as soon as it is written."""
        self.n += 1
        path = f"{self.root}/{self.n:02d}-{name}"
        conf, key = self.spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = conf.get(key, None)
        if free:
            conf.set(key, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            if free:
                conf.unset(key) if before is None else conf.set(key, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Delete a kept table that no later plan reads."""
        own = self.root.rsplit("/", 1)[1]
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if own in folder:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)


class IdFilter:
    """A bitmap of hashed ids: no id that was put in is ever left out, others pass by chance.

    It has 16 bits an id, 2**16 at least and ``most_bits`` at most (16 MiB by default), so its size
    as a broadcast is bounded whatever the input; a join afterwards removes the chance passes.
    """

    def __init__(self, ids: DataFrame, column: str, most_bits: int = 1 << 27):
        n = ids.count()
        self.bits = min(most_bits, 1 << max(16, (16 * n).bit_length()))
        at = F.pmod(F.xxhash64(F.col(column)), F.lit(self.bits))
        words = (
            ids.select(at.alias("q"))
            .select(F.shiftright("q", 6).alias("w"), F.expr("shiftleft(1L, cast(q % 64 as int))").alias("b"))
            .groupBy("w")
            .agg(F.bit_or("b").alias("b"))
            .toPandas()
        )
        self.words = np.zeros(self.bits // 64, dtype=np.uint64)
        if len(words):
            self.words[words["w"].to_numpy(dtype=np.int64)] = words["b"].to_numpy(dtype=np.int64).view(np.uint64)

    def __call__(self, hashed: np.ndarray) -> np.ndarray:
        """Which ``xxhash64`` values of ids may have been put in."""
        at = np.mod(hashed.astype(np.int64), np.int64(self.bits))
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
