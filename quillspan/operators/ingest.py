"""Snapshot upserts, work lists and logs: full-outer joins by key, written as new snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(incoming: DataFrame, key: str = "id", guard: str | None = "updated_at") -> DataFrame:
    """One row a key: the newest by the guard, of equal ones the greatest by a digest of the whole row. Rows without a key are left out."""
    columns = [F.col(f"`{c}`") for c in incoming.columns]
    plain = not any("map<" in t or t == "variant" for _, t in incoming.dtypes)
    # a hash of the columns, with which of them are null: hashing skips nulls
    digest = F.xxhash64(*[c.isNull() for c in columns], *columns) if plain else F.xxhash64(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    order = F.struct(*([F.col(f"`{guard}`")] if guard else []), digest)  # nulls are the least
    newest = incoming.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("row"))
    return newest.select("row.*")


def classify(stored: DataFrame, incoming: DataFrame, key: str = "id", guard: str | None = "updated_at") -> DataFrame:
    """key and action (inserted, updated, unchanged, kept). With a guard, equal ones (nulls too) are unchanged.

    Incoming rows without a key are skipped, and rows of one key count once (see ``latest``).
    """
    columns = [key] if guard is None else [key, guard]
    o = stored.select(*columns, F.lit(1).alias("have")).alias("o")
    n = latest(incoming, key, guard).select(*columns, F.lit(1).alias("got")).alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    same = F.lit(False) if guard is None else F.col(f"o.{guard}").eqNullSafe(F.col(f"n.{guard}"))
    action = F.when(F.col("got").isNull(), "kept").when(F.col("have").isNull(), "inserted").when(same, "unchanged").otherwise("updated")
    return joined.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), action.alias("action"))


def upsert(stored: DataFrame, incoming: DataFrame, key: str = "id", guard: str | None = "updated_at", insert_only: tuple[str, ...] = ("source_account_id",), reduced: bool = False) -> DataFrame:
    """The new snapshot. Columns of ``insert_only`` keep what was stored when a row is updated.

    reduced: incoming rows hold each key once already.
    """
    rows = incoming if reduced else latest(incoming, key, guard)
    o, n = stored.withColumn("have", F.lit(True)).alias("o"), rows.withColumn("got", F.lit(True)).alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    same = F.lit(False) if guard is None else F.col(f"o.{guard}").eqNullSafe(F.col(f"n.{guard}"))
    old = F.col("got").isNull() | (F.col("have").isNotNull() & same)

    def column(c: str) -> Column:
        if c not in incoming.columns:
            return F.col(f"o.{c}")
        take_old = old | F.col("have").isNotNull() if c in insert_only else old
        return F.when(take_old, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))

    return joined.select(*[column(c).alias(c) for c in stored.columns])


def upsert_stats(actions: DataFrame) -> DataFrame:
    return actions.agg(*[F.count_if(F.col("action") == a).alias(a) for a in ("inserted", "updated", "unchanged")])


def replace_children(stored: DataFrame, fresh: DataFrame, parents: DataFrame, key: str = "document_id") -> DataFrame:
    """Children of ``parents`` (key) are replaced by the fresh ones; those of others stay."""
    only = parents.select(key).distinct().hint("shuffle_hash")  # no key twice, so tables stay small; children needn't be sorted
    own = fresh.join(only, key, "left_semi")
    return stored.join(only, key, "left_anti").select(stored.columns).unionByName(own.select(stored.columns))


def upsert_calendars(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Selected calendars are inserted or updated, unselected ones only updated."""
    known = stored.select("id")
    rows = incoming.filter("selected").unionByName(incoming.filter("not selected").join(known, "id", "left_semi"))
    return upsert(stored, rows.drop("selected"), guard=None)


def redo_log(log: DataFrame, failures: DataFrame, successes: DataFrame) -> DataFrame:
    """The sync log after a run: failures (document_id, status, at) add an attempt, successes are cleared."""
    fresh = failures.select("document_id", "status", F.col("at").alias("last_attempted_at"), F.lit(1).alias("attempts"))
    both = log.select("document_id", "status", "last_attempted_at", "attempts").unionByName(fresh)
    merged = both.groupBy("document_id").agg(F.max_by("status", "last_attempted_at").alias("status"), F.max("last_attempted_at").alias("last_attempted_at"), F.sum("attempts").cast("int").alias("attempts"))
    return merged.join(successes, "document_id", "left_anti")


def without_transcripts(documents: DataFrame, utterances: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """Live documents without an utterance of a known channel, but for those whose failure is logged."""
    out = documents.filter("deleted_at is null").join(utterances.filter("source is not null").select(F.col("document_id").alias("id")), "id", "left_anti")
    return out if log is None else out.join(log.select(F.col("document_id").alias("id")), "id", "left_anti")


def without_panels(documents: DataFrame, panels: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """Live documents without a panel; a deleted panel counts as one."""
    out = documents.filter("deleted_at is null").join(panels.select(F.col("document_id").alias("id")), "id", "left_anti")
    return out if log is None else out.join(log.select(F.col("document_id").alias("id")), "id", "left_anti")


def failure_counts(log: DataFrame, documents: DataFrame) -> DataFrame:
    return log.join(documents, log["document_id"] == documents["id"], "left_semi").groupBy("status").agg(F.count("*").alias("n"))


def replace_transcript(stored: DataFrame, fresh: DataFrame, documents: DataFrame, fetched: DataFrame | None = None) -> DataFrame:
    """Transcripts replaced whole; unknown documents and rows without an id are skipped.

    fetched: document_id of all that were asked for, so that one that came back empty loses its old rows; None takes
    the documents that have fresh rows.
    """
    known = documents.select(F.col("id").alias("document_id"))
    good = fresh.filter("id is not null").join(known, "document_id", "left_semi")
    asked = good if fetched is None else fetched.join(known, "document_id", "left_semi")
    return replace_children(stored, good, asked.select("document_id"))


def stamp(metadata: DataFrame, entity: str, at: str) -> DataFrame:
    """metadata with last_sync_<entity> set."""
    key = f"last_sync_{entity}"
    row = metadata.sparkSession.createDataFrame([(key, at)], "key string, value string")
    return metadata.filter(F.col("key") != key).unionByName(row)


def last_sync(metadata: DataFrame, entity: str) -> DataFrame:
    return metadata.filter(F.col("key") == f"last_sync_{entity}").select("value")


def log_account(accounts: DataFrame, account_id: str, user_id: str, email: str, at: str) -> DataFrame:
    """accounts with this one; its first_seen_at stays when it is known."""
    new = accounts.sparkSession.createDataFrame([(account_id, user_id, email, at)], "account_id string, user_id string, email string, first_seen_at string").withColumn("first_seen_at", F.to_timestamp("first_seen_at"))
    w = Window.partitionBy("account_id").orderBy("first_seen_at")
    return accounts.unionByName(new).withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def backfill_account(rows: DataFrame, accounts: DataFrame, account_id: str) -> DataFrame:
    """Rows without an account get the first one ever seen; with others known nothing is filled in."""
    n = accounts.agg(F.count("*").alias("n_accounts"))
    filled = F.when(F.col("n_accounts") == 0, F.coalesce("source_account_id", F.lit(account_id))).otherwise(F.col("source_account_id"))
    return rows.crossJoin(F.broadcast(n)).withColumn("source_account_id", filled).drop("n_accounts")  # one row


def empty_account(fetched: int, stored: DataFrame) -> str | None:
    """A warning if nothing was fetched though something is stored."""
    if fetched == 0 and not stored.isEmpty():
        return "the account returned no documents, but some are stored: is it the right account?"
    return None


def fill_titles(documents: DataFrame) -> DataFrame:
    return documents.withColumn("title", F.coalesce("title", F.lit("")))


def fill_speakers(utterances: DataFrame) -> DataFrame:
    """speaker_name from the stored response where it is missing."""
    return utterances.withColumn("speaker_name", F.coalesce("speaker_name", F.get_json_object("api_snapshot", "$.detected_speaker_name")))


def transfer_decision(source: Column, target: Column, synced: Column) -> Column:
    """What to do with a copy, by content hashes: nothing, proceed, or stop because both sides changed."""
    return (
        F.when(source.eqNullSafe(target), "up_to_date")
        .when(target.isNull(), "proceed")
        .when(synced.isNull(), "unknown")
        .when(target == synced, "proceed")
        .otherwise("diverged")
    )
