"""The keyword index of a store: one stored index a source, kept in step with the tables by their feeds of changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.operators.textindex import TextIndex
from quillspan.sources.ranges import RangeTable
from quillspan.sources.store import Store

#: Segments that an index may have before they are merged.
MOST_SEGMENTS = 16

#: Each source's table, and its rows as (row_id, document_id, text, live).
SOURCES: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "transcripts": ("utterances", lambda df: df.select(F.col("id").alias("row_id"), "document_id", "text", F.lit(True).alias("live"))),
    "panels": ("panels", lambda df: df.select(F.col("id").alias("row_id"), "document_id", F.col("content_markdown").alias("text"), F.col("deleted_at").isNull().alias("live"))),
    "notes": ("documents", lambda df: df.select(F.col("id").alias("row_id"), F.col("id").alias("document_id"), F.col("notes_plain").alias("text"), F.lit(True).alias("live"))),
    "titles": ("documents", lambda df: df.select(F.col("id").alias("row_id"), F.col("id").alias("document_id"), F.col("title").alias("text"), F.lit(True).alias("live"))),
}


def catch_up(table: RangeTable, index: TextIndex, rows_of: Callable[[DataFrame], DataFrame]) -> bool:
    """Index what changed in a table since the commit that the index has seen; whether there was anything.

    A table that was written whole is indexed anew. Run again after a failure, it goes on from what was committed.
    """
    since, now = index.seen(), table.version()
    if now <= since:
        return False
    feeds = [table.commits.read(n) for n in table.commits.numbers() if since < n <= now]
    rows = rows_of(table.read(now))
    if since < 0 or any("changes" not in c and c.get("folder") for c in feeds):
        index.rebuild(rows, batch=now)
        return True
    own = "document_id" if table.by == "document_id" else "row_id"
    keys = table.changes(since).select(F.col("key").alias(own)).distinct()
    index.append(rows.join(keys, own, "left_semi"), removed=keys, batch=now)
    if index.statistics()["segments"] > MOST_SEGMENTS:
        index.merge()
    return True


def indexes(store: Store, targets: tuple[str, ...] | None = None) -> dict[str, TextIndex]:
    """The sources of ``search.search`` and ``commands.grep``."""
    return {s: TextIndex(store.spark, f"{store.root}/keyword/{s}") for s in SOURCES if targets is None or s in targets}


def refresh(store: Store) -> dict[str, bool]:
    """Bring all four indexes up to date; which had anything to do."""
    return {s: catch_up(store.table(SOURCES[s][0]), x, SOURCES[s][1]) for s, x in indexes(store).items()}
