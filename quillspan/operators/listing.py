"""Listing and lookup of meetings, people, calendars, events, templates and recipes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.dates import DateRange
from quillspan.functions.text import contains
from quillspan.operators.search import in_range


def like(column: Column, part: str) -> Column:
    """LIKE %part% without regard to case; % and _ in ``part`` are wildcards."""
    return F.coalesce(column.ilike(f"%{part}%"), F.lit(False))


def list_meetings(documents: DataFrame, dates: DateRange = DateRange(), include_deleted: bool = False) -> DataFrame:
    docs = documents.filter(in_range(F.col("created_at"), dates))
    if not include_deleted:
        docs = docs.filter("deleted_at is null")
    return docs.orderBy(F.col("created_at").desc(), F.col("id").asc())


def meetings_with(documents: DataFrame, document_people: DataFrame, person: str, dates: DateRange = DateRange(), end_inclusive: bool = False, include_deleted: bool = False) -> DataFrame:
    """Meetings of anyone whose address or name holds ``person``; a semi join, so nothing is made distinct."""
    whose = document_people.filter(like(F.col("email"), person) | like(F.col("full_name"), person))
    docs = documents.join(whose, documents["id"] == whose["document_id"], "left_semi").filter(in_range(F.col("created_at"), dates, end_inclusive))
    if not include_deleted:
        docs = docs.filter("deleted_at is null")
    return docs.orderBy(F.col("created_at").desc(), F.col("id").asc())


def _ranked_lookup(rows: DataFrame, exact: list[str], text: str, q: str) -> DataFrame:
    """The best row whose id (or a column of ``exact``) is q, whose id starts with q or whose ``text`` holds it."""
    same = F.col("id") == q
    for c in exact:
        same = same | (F.col(c) == q)
    rank = F.when(same, 0).when(F.startswith(F.col("id"), F.lit(q)), 1).when(like(F.col(text), q), 2)
    return rows.withColumn("priority", rank).filter("priority is not null").orderBy("priority", "id").limit(1)


def show_meeting(documents: DataFrame, q: str) -> DataFrame:
    return _ranked_lookup(documents.filter("deleted_at is null"), [], "title", q)


def resolve_document(documents: DataFrame, q: str) -> DataFrame:
    """Candidates of an id or its beginning: an exact one alone, else two at most (two are ambiguous)."""
    rank = F.when(F.col("id") == q, 0).otherwise(1)
    found = documents.filter(F.startswith(F.col("id"), F.lit(q))).select("id", rank.alias("rank"))
    return found.orderBy("rank", "id").limit(2).groupBy().agg(F.min(F.struct("rank", "id")).alias("first"), F.count("*").alias("n")).select(F.col("first.id").alias("id"), ((F.col("n") > 1) & (F.col("first.rank") == 1)).alias("ambiguous"), (F.col("n") > 0).alias("found"))


def fetch_in_order(documents: DataFrame, ids: list[str]) -> DataFrame:
    """Documents in the order asked for; unknown ids are skipped, deleted ones are not."""
    wanted = documents.sparkSession.createDataFrame(list(enumerate(ids)), "pos int, id string")
    return documents.join(F.broadcast(wanted), "id").orderBy("pos")  # a list that a caller wrote


def live_panels(panels: DataFrame, document_id: str) -> DataFrame:
    """A document's panels that aren't deleted, oldest first."""
    live = F.col("deleted_at").isNull() if "deleted_at" in panels.columns else ~F.col("deleted")
    return panels.filter(F.col("document_id") == document_id).filter(live).orderBy(F.col("created_at").asc_nulls_first(), "id")


def document_refs(documents: DataFrame) -> DataFrame:
    return documents.select("id", "title")


def meeting_filter(documents: DataFrame, part: str) -> DataFrame:
    return documents.filter(contains(F.col("title"), part) | contains(F.col("id"), part))


def list_people(people: DataFrame, company: str | None = None) -> DataFrame:
    rows = people.filter(like(F.col("company_name"), company)) if company is not None else people
    return rows.orderBy("name", "id")


def find_person(people: DataFrame, q: str) -> DataFrame:
    if not q.strip():
        raise ValueError("a person's id, name or address is needed")
    return people.filter((F.col("id") == q) | F.startswith(F.col("id"), F.lit(q)) | like(F.col("name"), q) | like(F.col("email"), q))


def list_events(events: DataFrame, calendar: str | None = None, dates: DateRange = DateRange()) -> DataFrame:
    rows = events.filter(in_range(F.col("start_time"), dates))
    if calendar is not None:
        rows = rows.filter(like(F.col("calendar_id"), calendar))
    return rows.orderBy(F.col("start_time").desc(), F.col("id").asc())


def list_templates(templates: DataFrame, category: str | None = None) -> DataFrame:
    rows = templates.filter(~F.col("deleted"))
    if category is not None:
        rows = rows.filter(like(F.col("category"), category))
    return rows.orderBy("title", "id")


def show_template(templates: DataFrame, q: str) -> DataFrame:
    """Deleted templates are shown too."""
    return _ranked_lookup(templates, [], "title", q)


def list_recipes(recipes: DataFrame, visibility: str | None = None) -> DataFrame:
    rows = recipes.filter(~F.col("deleted"))
    if visibility is not None:
        rows = rows.filter(F.col("visibility") == visibility)
    return rows.orderBy("slug", "id")


def show_recipe(recipes: DataFrame, q: str) -> DataFrame:
    return _ranked_lookup(recipes, ["slug"], "slug", q)
