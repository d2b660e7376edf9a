"""Readers of JSON landing zones, one for each response of the upstream service, and of golden sets.

A nested value that is stored as JSON is declared a string: Spark then keeps its text as it stands.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.text import chat_url, redacted, without_chat_line
from quillspan.functions.tiptap import tiptap_markdown
from quillspan.sources.schemas import GOLDEN, PEOPLE

_EVENT_TIME = "struct<dateTime: string, date_time: string, timeZone: string>"
DOCUMENTS = "docs array<struct<id: string, title: string, created_at: string, updated_at: string, deleted_at: string, `type`: string, notes_plain: string, notes_markdown: string, summary: string, people: string, google_calendar_event: string>>"
EVENTS = f"results struct<events: array<struct<id: string, summary: string, start: {_EVENT_TIME}, end: {_EVENT_TIME}, calendarId: string, calendar_id: string, status: string, attendees: string, description: string>>>"
UTTERANCE = "id string, document_id string, start_timestamp string, end_timestamp string, text string, source string, is_final boolean, detected_speaker_name string"
PERSON = "id string, name string, email string, company_name string, job_title string"
PANEL = "id string, document_id string, title string, content string, original_content string, generated_lines string, suggested_questions string, template_slug string, created_at string, updated_at string, deleted_at string"
TEMPLATE = "id string, title string, category string, symbol string, color string, description string, sections string, {builtin} boolean, created_at string, updated_at string, deleted_at string"
_RECIPE = "array<struct<id: string, slug: string, visibility: string, publisher_slug: string, creator_name: string, config: string, created_at: string, updated_at: string, deleted_at: string>>"
#: Buckets of the recipe response, and the visibility of recipes that name none.
RECIPE_BUCKETS = {"defaultRecipes": "default", "publicRecipes": "public", "sharedRecipes": "shared", "userRecipes": "user", "unlistedRecipes": "unlisted"}
RECIPES = ", ".join(f"{b} {_RECIPE}" for b in RECIPE_BUCKETS)
#: Bulky fields of a panel and of an utterance, noted as stored in what is kept of a response.
PANEL_BULK = {"content", "original_content", "generated_lines", "suggested_questions"}
UTTERANCE_BULK = {"text"}
CALENDARS = "calendars_selected map<string, boolean>, enabled_calendars array<struct<id: string, provider: string, `primary`: boolean, accessRole: string, summary: string, backgroundColor: string>>"


def _json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """lines: a response in each line instead of one a file."""
    return spark.read.schema(schema).option("multiLine", "false" if lines else "true").json(path)


def _instants(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.try_to_timestamp(F.col(c)) for c in columns})


def documents(spark: SparkSession, path: str) -> DataFrame:
    rows = _json(spark, path, DOCUMENTS).select(F.explode("docs").alias("d")).select("d.*").withColumnsRenamed({"type": "doc_type", "people": "people_json", "google_calendar_event": "event_json"})
    return _instants(rows, "created_at", "updated_at", "deleted_at").withColumn("title", F.coalesce("title", F.lit("")))


def people(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, PERSON)


def selected_calendars(spark: SparkSession, path: str) -> DataFrame:
    """id, selected and the details of calendars that have any; unselected ones too."""
    raw = _json(spark, path, CALENDARS)
    chosen = raw.select(F.explode("calendars_selected").alias("id", "selected"))
    details = raw.select(F.explode("enabled_calendars").alias("c")).select("c.*").withColumnsRenamed({"accessRole": "access_role", "backgroundColor": "background_color"})
    return chosen.join(details, "id", "left")


def events(spark: SparkSession, path: str) -> DataFrame:
    """Either spelling of a field is taken, the camel-case one first."""
    e = _json(spark, path, EVENTS).select(F.explode("results.events").alias("e"))
    return e.select(
        "e.id",
        "e.summary",
        F.try_to_timestamp(F.coalesce("e.start.dateTime", "e.start.date_time")).alias("start_time"),
        F.try_to_timestamp(F.coalesce("e.end.dateTime", "e.end.date_time")).alias("end_time"),
        F.coalesce("e.calendarId", "e.calendar_id").alias("calendar_id"),
        "e.status",
        F.col("e.attendees").alias("attendees_json"),
        "e.description",
    )


def templates(spark: SparkSession, path: str, builtin: str = "is_builtin") -> DataFrame:
    """builtin: the response's field that says whether a template is the service's own."""
    rows = _json(spark, path, TEMPLATE.format(builtin=f"`{builtin}`")).withColumnsRenamed({builtin: "is_builtin", "sections": "sections_json"})
    return _instants(rows, "created_at", "updated_at", "deleted_at")


def panels(spark: SparkSession, path: str, chat_host: str | None = None, lines: bool = False) -> DataFrame:
    """Panels as Markdown; a line that links to ``chat_host`` is cut off and its address kept as chat_url."""
    raw = _json(spark, path, PANEL, lines)
    rows = raw.withColumns({"content_json": F.col("content"), "content_markdown": tiptap_markdown("content"), "api_snapshot": redacted(raw.columns, PANEL_BULK)})
    if chat_host is not None:
        rows = rows.withColumns({"chat_url": chat_url(F.col("content_markdown"), chat_host), "content_markdown": without_chat_line(F.col("content_markdown"), chat_host)})
    return _instants(rows.drop(*PANEL_BULK), "created_at", "updated_at", "deleted_at")


def recipes(spark: SparkSession, path: str) -> DataFrame:
    raw = _json(spark, path, RECIPES)
    parts = [raw.select(F.explode(b).alias("r")).select("r.*").withColumn("visibility", F.coalesce("visibility", F.lit(v))) for b, v in RECIPE_BUCKETS.items()]
    return _instants(reduce(DataFrame.unionByName, parts).withColumnRenamed("config", "config_json"), "created_at", "updated_at", "deleted_at")


def transcript(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    raw = _json(spark, path, UTTERANCE, lines)
    rows = raw.withColumns({"api_snapshot": redacted(raw.columns, UTTERANCE_BULK), "transcript_source": F.lit("api")})
    return _instants(rows, "start_timestamp", "end_timestamp").withColumnRenamed("detected_speaker_name", "speaker_name")


def fetched(spark: SparkSession, root: str, kind: str, lines: bool = False) -> DataFrame | None:
    """document_id and status (null: it came) of the documents whose ``kind`` was asked for; None where no list was left."""
    try:
        rows = _json(spark, f"{root}/fetched", "document_id string, kind string, status string", lines)
    except AnalysisException:  # no such folder
        return None
    return rows.filter(F.col("kind") == kind).select("document_id", "status")


def document_people(documents: DataFrame) -> DataFrame:
    """The bridge rows in documents' people_json: the creator, then attendees, by full name or else name."""
    p = documents.select(F.col("id").alias("document_id"), F.from_json("people_json", PEOPLE).alias("p"))
    name = lambda c: F.coalesce(c["details"]["person"]["name"]["fullName"], c["name"])
    creator = p.filter("p.creator is not null").select("document_id", F.col("p.creator.email").alias("email"), name(F.col("p.creator")).alias("full_name"), F.lit("creator").alias("role"))
    attendee = p.select("document_id", F.explode("p.attendees").alias("a")).select("document_id", F.col("a.email").alias("email"), name(F.col("a")).alias("full_name"), F.lit("attendee").alias("role"))
    return creator.unionByName(attendee).withColumn("source", F.lit("people"))


def golden_set(spark: SparkSession, path: str) -> DataFrame:
    """query_no, query, query_type, label, by_id of a golden set; what can't be scored is an error."""
    queries = _json(spark, path, GOLDEN).select(F.posexplode("queries").alias("query_no", "q")).select("query_no", "q.*")
    bad = queries.filter("trim(coalesce(query, '')) = '' or (coalesce(size(relevant_meetings), 0) <= 0 and coalesce(size(relevant_meeting_ids), 0) <= 0)")
    if queries.isEmpty() or not bad.isEmpty():
        raise ValueError("a golden set needs queries, each with words and at least one relevant meeting")
    by_id = queries.select("query_no", "query", "query_type", F.explode("relevant_meeting_ids").alias("label"), F.lit(True).alias("by_id"))
    by_title = queries.filter("coalesce(size(relevant_meeting_ids), 0) <= 0").select("query_no", "query", "query_type", F.explode("relevant_meetings").alias("label"), F.lit(False).alias("by_id"))
    return by_id.unionByName(by_title)
