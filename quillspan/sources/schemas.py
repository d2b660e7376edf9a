"""Explicit schemas of the engine's tables; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = 3  # of the stored tables: the last step of ``migrations.STEPS``

TABLES = {
    "documents": "id string, title string, created_at timestamp, updated_at timestamp, deleted_at timestamp, doc_type string, notes_plain string, notes_markdown string, summary string, people_json string, event_json string, extra_json string, raw_json string, source_account_id string",
    "utterances": "id string, document_id string, start_timestamp timestamp, end_timestamp timestamp, text string, transcript_source string, source string, is_final boolean, api_snapshot string, speaker_name string",
    "panels": "id string, document_id string, title string, content_json string, content_markdown string, template_slug string, created_at timestamp, updated_at timestamp, deleted_at timestamp, chat_url string, api_snapshot string",
    "people": "id string, name string, email string, company_name string, job_title string, extra_json string, source_account_id string",
    "document_people": "document_id string, email string, full_name string, role string, source string",
    "calendars": "id string, provider string, `primary` boolean, access_role string, summary string, background_color string, source_account_id string",
    "events": "id string, summary string, start_time timestamp, end_time timestamp, calendar_id string, attendees_json string, description string, source_account_id string",
    "templates": "id string, title string, category string, symbol string, color string, description string, is_builtin boolean, sections_json string, created_at timestamp, updated_at timestamp, deleted_at timestamp, source_account_id string",
    "recipes": "id string, slug string, visibility string, publisher_slug string, creator_name string, config_json string, created_at timestamp, updated_at timestamp, deleted_at timestamp, source_account_id string",
    "chunks": "source_type string, source_id string, document_id string, content_hash string, text string, metadata_json string, created_at timestamp",
    "embeddings": "source_type string, source_id string, vector array<float>",
    "metadata": "key string, value string",
    "sync_log": "document_id string, status string, last_attempted_at timestamp, attempts int",
    "panel_sync_log": "document_id string, status string, last_attempted_at timestamp, attempts int",
    "accounts": "account_id string, user_id string, email string, first_seen_at timestamp",
}

#: What tells a table's rows apart and, where that is another column, what its ranges are of. Others: id.
KEYS = {
    "utterances": ("id", "document_id"),
    "panels": ("id", "document_id"),
    "document_people": ("email", "document_id"),
    "chunks": ("source_id", "document_id"),
    "embeddings": ("source_id", None),
    "metadata": ("key", None),
    "sync_log": ("document_id", None),
    "panel_sync_log": ("document_id", None),
    "accounts": ("account_id", None),
}

_PERSON = "struct<name: string, email: string, details: struct<person: struct<name: struct<fullName: string>>>>"
PEOPLE = f"title string, creator {_PERSON}, attendees array<{_PERSON}>"
GOLDEN = "queries array<struct<query: string, query_type: string, relevant_meetings: array<string>, relevant_meeting_ids: array<string>>>"


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored table, later columns as nulls where a file is older than they are."""
    return spark.read.schema(TABLES[name]).option("mergeSchema", "true").parquet(f"{root}/{name}")


def missing_columns(df: DataFrame, name: str) -> list[str]:
    """Structure check of a table that came from elsewhere: columns that are absent or of another type."""
    have = {f.name: f.dataType for f in df.schema}
    return sorted(f.name for f in T.StructType.fromDDL(TABLES[name]) if have.get(f.name) != f.dataType)


def schema_version(metadata: DataFrame) -> DataFrame:
    return metadata.filter("key = 'schema_version'").select(F.col("value").cast("int").alias("version"))
