"""Opening a store: ordered steps bring its rows to the present version, each once, after a backup.

A step reads and upserts the rows that it changes, so it writes their ranges only, and may be run again after it failed
halfway. The version is written after each step: an opening that failed goes on with the step that failed. The backup is
a list of the tables' commits (their files never change), kept as a commit of its own; ``restore`` goes back to one.
A store without a version and with rows is one of before the first step. A new store gets the present version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillspan.operators import ingest
from quillspan.sources.commits import Commits
from quillspan.sources.schemas import TABLES, VERSION, schema_version
from quillspan.sources.store import Store


def fill_titles(store: Store) -> None:
    """Titles are never null."""
    rows = store.read("documents").filter("title is null")
    if not rows.isEmpty():
        store.table("documents").upsert(ingest.fill_titles(rows), insert_only=())


def fill_speakers(store: Store) -> None:
    """Speakers' names from the stored responses."""
    rows = ingest.fill_speakers(store.read("utterances").filter("speaker_name is null and api_snapshot is not null")).filter("speaker_name is not null")
    if not rows.isEmpty():
        store.table("utterances").upsert(rows, insert_only=())


#: Each step makes the version of its number.
STEPS: dict[int, Callable[[Store], None]] = {1: lambda store: None, 2: fill_titles, 3: fill_speakers}


def version(store: Store) -> int | None:
    """The store's version; None for a new one."""
    found = schema_version(store.read("metadata")).first()
    if found is not None and found["version"] is not None:
        return found["version"]
    return 0 if any(store.version(name) >= 0 for name in TABLES) else None


def backup(store: Store) -> int:
    """Note the tables' commits; the backup's number. ``drop_before`` must not delete what a backup names."""
    log = Commits(store.spark, f"{store.root}/backups")
    n = log.head()[0] + 1
    log.commit(n, {"version": version(store), "tables": {name: store.version(name) for name in TABLES}})
    return n


def restore(store: Store, n: int) -> None:
    """Make a backup's rows the tables again."""
    for name, at in Commits(store.spark, f"{store.root}/backups").read(n)["tables"].items():
        if store.version(name) != at:
            store.table(name).restore(at)


def open_store(spark: SparkSession, root: str) -> Store:
    """The store of ``root`` at the present version; ``ValueError`` for one of a later version."""
    store = Store(spark, root)
    have = version(store)
    if have is not None and have > VERSION:
        raise ValueError(f"the store has version {have}, this library knows {VERSION}")
    pending = [] if have is None else sorted(n for n in STEPS if n > have)
    if have is None:
        _stamp(store, VERSION)
    elif pending:
        backup(store)
    for n in pending:
        STEPS[n](store)
        _stamp(store, n)
    return store


def _stamp(store: Store, n: int) -> None:
    store.table("metadata").upsert(store.spark.range(1).select(F.lit("schema_version").alias("key"), F.lit(str(n)).alias("value")))
