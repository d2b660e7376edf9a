"""The stored tables, each in ranges of its key's hash (see ``RangeTable``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspan.sources.ranges import RangeTable
from quillspan.sources.schemas import KEYS, TABLES


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def table(self, name: str) -> RangeTable:
        key, by = KEYS.get(name, ("id", None))
        return RangeTable(self.spark, f"{self.root}/{name}", TABLES[name], key, by)

    def version(self, name: str) -> int:
        """The last commit's number; -1 before the first."""
        return self.table(name).version()

    def read(self, name: str) -> DataFrame:
        """The table of the last commit with its schema; columns that a file is older than are null. Empty before the first."""
        return self.table(name).read()

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """Make ``df`` the table; plans that still read the old one go on."""
        self.table(name).replace(df)
        return self.read(name)

    def drop_before(self, name: str, n: int) -> None:
        """Delete what only commits older than n hold; those that a plan still reads must not be among them."""
        self.table(name).drop_before(n)
