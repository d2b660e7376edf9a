"""A full sync: every entity's landing zone upserted into the store, then transcripts, panels and the index.

An entity that fails is reported and the others go on. Every entity that succeeds stamps its time. The first account ever
seen is filled in where rows have none.
"""

from __future__ import annotations

import traceback
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators import ingest
from quillspan.plans import index
from quillspan.sources import landing, live
from quillspan.sources.store import Store

#: Tables whose rows name the account that they came from.
OF_ACCOUNTS = ("documents", "people", "calendars", "events", "templates", "recipes")
#: Where failed fetches of each kind are logged.
LOGS = {"utterances": "sync_log", "panels": "panel_sync_log"}
#: Entities whose rows are compared by updated_at; the others are always taken.
GUARDED = {"documents", "templates", "recipes"}
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "documents": landing.documents,
    "people": landing.people,
    "events": landing.events,
    "templates": landing.templates,
    "recipes": landing.recipes,
}


def _columns_of(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming rows with the stored table's columns, as far as they have them."""
    return incoming.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in stored.schema if f.name in incoming.columns])


def sync_entity(store: Store, name: str, incoming: DataFrame, account: str | None = None) -> dict[str, int]:
    """Upsert one entity; returns how many rows were inserted, updated and left as they were.

    Only ranges of keys with a changed row are written; a document's people are replaced where the document changed.
    """
    table = store.table(name)
    before, stored = table.version(), store.read(name)
    guard = "updated_at" if name in GUARDED else None
    rows = _columns_of(incoming, stored)
    if account is not None and "source_account_id" in stored.columns:
        rows = rows.withColumn("source_account_id", F.lit(account))
    counts = table.upsert(rows, guard)
    if name == "documents" and "people_json" in rows.columns and table.version() > before:
        changed = table.changes(before).select(F.col("key").alias("document_id")).distinct()
        with_people = rows.filter("people_json is not null").select(F.col("id").alias("document_id")).join(changed, "document_id", "left_semi")
        store.table("document_people").replace_children(landing.document_people(rows), with_people)
    return counts


def stamp(store: Store, entity: str, at: str) -> None:
    store.table("metadata").upsert(store.spark.createDataFrame([(f"last_sync_{entity}", at)], "key string, value string"))


def see_account(store: Store, account: str, user: str | None, email: str | None, at: str) -> None:
    """Log an account; if it is the first ever, rows stored without one become its own."""
    known = store.read("accounts")
    if known.isEmpty():
        for name in OF_ACCOUNTS:
            rows = store.read(name)
            if not rows.filter("source_account_id is null").isEmpty():
                store.write(name, ingest.backfill_account(rows, known, account))
    store.write("accounts", ingest.log_account(known, account, user, email, at))


def full_sync(store: Store, landing_root: str, at: str, account: str | None = None, only: list[str] | None = None, user: str | None = None, email: str | None = None, chat_host: str | None = None, embedder: tuple[Callable, str, int] | None = None, lines: bool = False) -> dict[str, dict]:
    """Sync all entities (or ``only`` some) from ``<landing_root>/<entity>``; returns each one's counts or error.

    embedder: what makes the model, its name and its width; with it the index is brought up to date at the end.
    ``<landing_root>/fetched`` may list (document_id, kind, status) of what was asked for, status being null where it came. lines: transcripts, panels and that list lie as a response a line (``live.land``).
    """
    out: dict[str, dict] = {}
    if account is not None:
        see_account(store, account, user, email, at)
    for name in [*READERS, "calendars", "utterances", "panels"] if only is None else only:
        path = f"{landing_root}/{name}"
        try:
            if name == "calendars":
                store.write("calendars", ingest.upsert_calendars(store.read("calendars"), _calendar_rows(store, landing.selected_calendars(store.spark, path))))
                out[name] = {}
            elif name == "utterances":
                out[name] = _children(store, "utterances", landing.transcript(store.spark, path, lines), landing.fetched(store.spark, landing_root, "transcript", lines), at)
            elif name == "panels":
                out[name] = _children(store, "panels", landing.panels(store.spark, path, chat_host, lines), landing.fetched(store.spark, landing_root, "panels", lines), at)
            else:
                incoming = READERS[name](store.spark, path)
                if name == "documents" and (warning := ingest.empty_account(incoming.count(), store.read("documents"))):
                    raise ValueError(warning)
                out[name] = sync_entity(store, name, incoming, account)
            stamp(store, {"utterances": "transcripts"}.get(name, name), at)
        except Exception as e:  # noqa: BLE001  an entity's errors must not stop the others
            out[name] = _error(e)
    if embedder is not None:
        try:
            out["index"] = index.refresh(store, *embedder)
        except Exception as e:  # noqa: BLE001  what was synced stays
            out["index"] = _error(e)
    return out


def live_sync(store: Store, url: str, token: str | None, landing_root: str, at: str, retry: bool = False, only: list[str] | None = None, chat_host: str | None = None, account: str | None = None, embedder: tuple[Callable, str, int] | None = None, **options: object) -> dict[str, dict]:
    """A full sync from the service itself, through a landing zone of this run: a new folder.

    Kinds in one answer first; then transcripts and panels of the documents that lack them, logged failures only to
    ``retry`` them. A kind that can't be fetched is reported and the others go on. options: of ``live``'s source.
    """
    kinds = only or list(live.PATHS)
    out: dict[str, dict] = {}

    def fetch(kind: str, queue: str | None = None) -> bool:
        try:
            live.land(live.answers(store.spark, kind, url, token, queue, **options), landing_root, kind)
        except Exception as e:  # noqa: BLE001  as in ``full_sync``
            out[live.BY_DOCUMENT.get(kind, kind)] = _error(e)
            return False
        return True

    if whole := [k for k in kinds if k not in live.BY_DOCUMENT and fetch(k)]:
        out |= full_sync(store, landing_root, at, account, whole, chat_host=chat_host)
    asked = [k for k in kinds if k in live.BY_DOCUMENT]
    todo = work_list(store, retry)
    for kind in asked:
        live.enqueue(store.spark, todo.filter(F.col("kind") == kind).select(F.col("id").alias("document_id")), f"{landing_root}/queue/{kind}")
    if got := [live.BY_DOCUMENT[k] for k in asked if fetch(k, f"{landing_root}/queue/{k}")]:
        out |= full_sync(store, landing_root, at, only=got, chat_host=chat_host, lines=True)
    if embedder is not None:
        out |= full_sync(store, landing_root, at, only=[], embedder=embedder)
    return out


def _error(e: Exception) -> dict[str, str]:
    return {"error": str(e).splitlines()[0] if str(e) else type(e).__name__, "type": type(e).__name__, "trace": traceback.format_exc()}


def _calendar_rows(store: Store, incoming: DataFrame) -> DataFrame:
    stored = store.read("calendars")
    return incoming.select("selected", *[(F.col(f"`{f.name}`") if f.name in incoming.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in stored.schema])


def _children(store: Store, name: str, fresh: DataFrame, asked: DataFrame | None, at: str) -> dict[str, int]:
    """Transcripts or panels replaced whole: of the documents that were asked for and came, or of those with fresh rows."""
    stored, documents = store.read(name), store.read("documents")
    rows = fresh.select(*[(F.col(f"`{f.name}`") if f.name in fresh.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in stored.schema])
    came = rows.select("document_id").distinct() if asked is None else asked.filter("status is null").select("document_id").distinct()
    known = documents.select(F.col("id").alias("document_id"))
    store.table(name).replace_children(rows.filter("id is not null"), came.join(known, "document_id", "left_semi"))
    failed = rows.limit(0).selectExpr("document_id", "'' as status") if asked is None else asked.filter("status is not null").select("document_id", "status")
    log = LOGS[name]
    store.write(log, ingest.redo_log(store.read(log), failed.withColumn("at", F.try_to_timestamp(F.lit(at))), came))
    return {"documents": rows.select("document_id").distinct().count()}


def work_list(store: Store, retry: bool = False) -> DataFrame:
    """Documents whose transcripts or panels are to be fetched; logged failures only to ``retry`` them."""
    logs = {name: None if retry else store.read(log) for name, log in LOGS.items()}
    documents = store.read("documents")
    transcripts = ingest.without_transcripts(documents, store.read("utterances"), logs["utterances"]).select("id", F.lit("transcript").alias("kind"))
    return transcripts.unionByName(ingest.without_panels(documents, store.read("panels"), logs["panels"]).select("id", F.lit("panels").alias("kind")))


def accounts_seen(store: Store) -> DataFrame:
    return store.read("accounts").orderBy("first_seen_at", "account_id")


def account_email(store: Store, account_id: str) -> str | None:
    found = store.read("accounts").filter(F.col("account_id") == account_id).select("email").first()
    return found["email"] if found else None
