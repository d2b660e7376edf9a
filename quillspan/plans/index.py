"""The vector index kept up to date: desired chunks against stored ones, and only what differs is embedded.

The tables' feeds of changes say which documents changed since the last run: only these are cut into chunks, compared
and written. A run over everything is made where there is no last run, the model or the settings are others, or a
table was written whole.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.operators import chunking, embed, stats
from quillspan.sources.store import Store

#: Tables that chunks and headers are made from, and the metadata key of the commits that the index has seen.
INPUTS = ("documents", "utterances", "panels", "document_people")
SEEN = "indexed_commits"
_KEY = ["source_type", "source_id"]


def changed_documents(store: Store, seen: dict[str, int]) -> DataFrame | None:
    """document_id of what changed after the commits ``seen``; None if a table was written whole since."""
    found = store.spark.createDataFrame([], "document_id string")
    for name in INPUTS:
        table = store.table(name)
        since = seen.get(name, -1)
        commits = [table.commits.read(n) for n in table.commits.numbers() if n > since]
        if any("changes" not in c and c.get("folder") for c in commits):
            return None
        found = found.unionByName(table.changes(since).select(F.col("key").alias("document_id")))
    return found.distinct()


def desired_chunks(store: Store, config: chunking.Config = chunking.Config(), headers: bool = False, only: DataFrame | None = None) -> DataFrame:
    """Chunks of all live transcripts, panels and notes, with headers and hashes; of ``only`` some documents (document_id)."""

    def of(name: str, column: str = "document_id") -> DataFrame:
        rows = store.read(name)
        return rows if only is None else rows.join(only.select(F.col("document_id").alias(column)), column, "left_semi")

    documents = of("documents", "id")
    made = chunking.document_headers(documents, of("document_people")) if headers else None
    panels = of("panels").withColumn("deleted", F.col("deleted_at").isNotNull())
    said = of("utterances").withColumn("seq", F.col("id"))
    notes = chunking.Config(**{**config.__dict__, "min_chars": 20})
    parts = chunking.transcript_chunks(said, config, made), chunking.panel_chunks(panels, config, made), chunking.note_chunks(documents, notes, made)
    return chunking.desired(*parts, headers=made)


def refresh(store: Store, make: Callable[[], embed.Embedder], model: str, dim: int, config: chunking.Config = chunking.Config(), headers: bool = False) -> dict[str, int]:
    """Bring the index up to date; returns how many chunks were embedded, refreshed, left, removed and failed.

    The sync stamps and the tables' commits are read before anything else, and are claimed only if no batch failed. Vectors
    of another model all go. If nothing differs, no model is made.
    """
    metadata = store.read("metadata")
    claim = stats.newest_stamp(metadata).first()["stamp"]
    now = {name: store.version(name) for name in INPUTS}
    same = embed.matches_model(metadata, model, dim)
    settings = {"model_name": model, "embedding_dim": str(dim), **config.notes(), "contextual_headers": str(headers).lower()}
    known = {r["key"]: r["value"] for r in metadata.filter(F.col("key").isin(SEEN, *settings)).collect()}
    only = None
    if SEEN in known and all(known.get(k) == v for k, v in settings.items()):
        only = changed_documents(store, json.loads(known[SEEN]))
    if only is not None:
        only = _kept(store, only, "changed")
    all_stored = store.read("chunks")
    stored = all_stored if same else all_stored.limit(0)
    if only is not None:
        stored = stored.join(only, "document_id", "left_semi")
    wanted = desired_chunks(store, config, headers, only)
    actions = chunking.diff(wanted, stored)
    counts = {r["action"]: r["n"] for r in actions.groupBy("action").agg(F.count("*").alias("n")).collect()}
    elsewhere = 0 if only is None else all_stored.count() - stored.count()
    vectors = store.read("embeddings")
    kept = vectors.join(actions.filter("action in ('unchanged', 'refresh')").select(*_KEY), _KEY, "left_semi")
    failed = 0
    if counts.get("embed"):
        todo = wanted.join(actions.filter("action = 'embed'").select(*_KEY), _KEY, "left_semi")
        results = _kept(store, embed.embed(todo, make), "run")
        failed = results.filter("error is not null").count()
        kept = kept.unionByName(results.filter("error is null").select(*_KEY, "vector"))
    if counts.keys() - {"unchanged"} or not same:
        when = F.current_timestamp().alias("created_at")
        columns = [*_KEY, "document_id", "content_hash", "text", "metadata_json", when]
        # a chunk whose batch failed isn't stored, so the next run takes it again
        if only is None:
            done = store.write("embeddings", kept)
            store.write("chunks", wanted.join(done.select(*_KEY), _KEY, "left_semi").select(*columns))
        else:
            own = stored.select("source_id").unionByName(wanted.select("source_id")).distinct()
            fresh = _kept(store, wanted.select("source_type", "source_id", "document_id", "content_hash", "text", "metadata_json"), "wanted")
            store.table("embeddings").replace_children(kept, own)
            done = store.read("embeddings").select(*_KEY)
            store.table("chunks").replace_children(fresh.join(done, _KEY, "left_semi").select(*columns), only)
    notes = dict(settings)
    if not failed:
        notes[SEEN] = json.dumps(now)
        if claim is not None:
            notes["embedded_sync_watermark"] = claim
    store.table("metadata").upsert(store.spark.createDataFrame(list(notes.items()), "key string, value string"))
    store.table("embeddings").commits.delete(f"{store.root}/embedding-runs")
    return {a: counts.get(a, 0) + (elsewhere if a == "unchanged" else 0) for a in ("embed", "refresh", "unchanged", "orphan")} | {"failed": failed}


def _kept(store: Store, df: DataFrame, name: str) -> DataFrame:
    """Rows of a run, written so that they are made once."""
    path = f"{store.root}/embedding-runs/{name}"
    df.write.mode("overwrite").parquet(path)
    return store.spark.read.schema(df.schema).parquet(path)


def clear(store: Store, newest: int | None = None) -> None:
    """Remove all chunks and vectors, or the newest; the index claims no stamp and no commits any more."""
    chunks = store.read("chunks")
    left = chunks.limit(0) if newest is None else chunking.without_newest(chunks, newest)
    kept = store.write("chunks", left)
    store.write("embeddings", store.read("embeddings").join(kept.select(*_KEY), _KEY, "left_semi"))
    store.table("metadata").remove(store.spark.createDataFrame([("embedded_sync_watermark",), (SEEN,)], "key string"))
