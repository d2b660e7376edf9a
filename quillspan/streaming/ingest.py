"""Continuous ingestion: landing JSON to a stored table and its keyword index, one micro-batch after another.

A batch is upserted by key range, so it rewrites what it touches; its number is in the commit, and a batch that is run
again after a failure is passed over. The index follows the table's feed of changes: one segment a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quillspan.operators.textindex import TextIndex
from quillspan.plans.keyword import catch_up
from quillspan.sources.ranges import RangeTable


class SnapshotSink:
    """Upserts micro-batches of one table under ``root``, and indexes their text."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, key: str = "id", guard: str | None = "updated_at", text: str | None = None):
        self.spark, self.schema, self.key, self.guard, self.text = spark, schema, key, guard, text
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        self.table, self.index = RangeTable(spark, f"{root}/rows", ddl, key), TextIndex(spark, f"{root}/index")

    def current(self) -> int:
        """The last batch that changed the table; -1 before the first."""
        return self.table.commits.head()[1].get("batch", -1)

    def read(self, what: str = "rows") -> DataFrame:
        return self.table.read() if what == "rows" else self.index.postings()

    def write(self, batch: DataFrame, n: int) -> None:
        """For foreachBatch. Of equal keys in a batch the latest by the guard counts."""
        if n > self.current():
            self.table.upsert(batch, self.guard, insert_only=(), note={"batch": n})
        if self.text:
            catch_up(self.table, self.index, lambda df: df.select(F.col(self.key).alias("row_id"), F.col(self.key).alias("document_id"), F.col(self.text).alias("text")))

    def start(self, landing: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
        stream = self.spark.readStream.schema(self.schema).json(landing)
        writer = stream.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
