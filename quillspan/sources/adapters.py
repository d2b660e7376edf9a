"""The driver's tables seen as the engine's: views, no copies. ``SQL`` has the same views for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.batches import small_batches

EPOCH = "timestamp '2024-01-01 00:00:00'"


class Tables:
    """Engine tables over a folder of the driver's parquet files."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        small_batches(spark)

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def documents(self) -> DataFrame:
        head = F.regexp_extract("text", r"^[ \n\t]*((?:[^ \n\t]+[ \n\t]*){0,6})", 1)
        title = F.array_join(F.filter(F.split(head, r"[ \n\t]+"), lambda w: w != ""), " ")
        created = F.expr(f"{EPOCH} + make_interval(0, 0, 0, cast(doc_id % 365 as int))")
        return self.raw("documents").select(
            F.col("doc_id").cast("string").alias("id"),
            title.alias("title"),
            created.alias("created_at"),
            F.expr(f"{EPOCH} + make_interval(0, 0, 0, cast(doc_id % 365 as int), cast(doc_id % 7 as int))").alias("updated_at"),
            F.expr(f"case when doc_id % 17 = 0 then {EPOCH} + make_interval(0, 0, 0, cast(doc_id % 365 + 1 as int)) end").alias("deleted_at"),
            F.col("source").alias("doc_type"),
            F.col("text").alias("notes_plain"),
        )

    def utterances(self) -> DataFrame:
        return self.raw("conversations").select(
            F.expr("concat(conv_id, ':', turn)").alias("id"),
            F.col("conv_id").cast("string").alias("document_id"),
            F.col("turn").alias("seq"),
            F.expr(f"{EPOCH} + make_interval(0, 0, 0, cast(conv_id % 365 as int), 0, 0, turn * 30)").alias("start_timestamp"),
            F.expr(f"{EPOCH} + make_interval(0, 0, 0, cast(conv_id % 365 as int), 0, 0, turn * 30 + 5 + turn % 20)").alias("end_timestamp"),
            "text",
            F.expr("case role when 'user' then 'microphone' when 'assistant' then 'system' end").alias("source"),
            F.expr("case when role = 'assistant' and conv_id % 4 > 0 then concat('Speaker ', conv_id % 4) end").alias("speaker_name"),
        )

    def people(self) -> DataFrame:
        return self.raw("customer").select(
            F.col("c_custkey").cast("string").alias("id"),
            F.col("c_name").alias("name"),
            F.expr("concat('c', c_custkey, '@', lower(c_mktsegment), '.example')").alias("email"),
            F.col("c_mktsegment").alias("company_name"),
            F.expr("concat('nation ', c_nationkey)").alias("job_title"),
        )

    def document_people(self) -> DataFrame:
        """An order is one person's part in a document."""
        o, p = self.raw("orders"), self.people()
        return o.join(p, o["o_custkey"].cast("string") == p["id"]).select(
            F.expr("cast(o_orderkey div 15 as string)").alias("document_id"), "email", F.expr("case when o_custkey % 10 > 0 then name end").alias("full_name"), F.expr("case when o_orderpriority like '1%' then 'creator' else 'attendee' end").alias("role")
        )

    def calendars(self) -> DataFrame:
        n, r = self.raw("nation"), self.raw("region")
        return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_nationkey").cast("string").alias("id"), F.col("r_name").alias("provider"), (F.col("n_nationkey") % 5 == 0).alias("primary"), F.col("n_name").alias("summary"))

    def events(self) -> DataFrame:
        return self.raw("events").select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("summary"), F.col("ts").alias("start_time"), F.expr("concat('cal-', user_id % 25)").alias("calendar_id"))

    def templates(self) -> DataFrame:
        return self.raw("part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("category"), F.expr("p_partkey % 11 = 0").alias("deleted"))

    def recipes(self) -> DataFrame:
        visibility = F.expr("case p_partkey % 3 when 0 then 'public' when 1 then 'user' else 'shared' end")
        return self.raw("part").select(F.col("p_partkey").cast("string").alias("id"), F.expr("concat(lower(replace(p_name, ' ', '-')), '-', p_partkey)").alias("slug"), visibility.alias("visibility"), F.expr("p_partkey % 13 = 0").alias("deleted"))

    def panels(self) -> DataFrame:
        """Each document's lines as sections under headings, with a footer."""
        body = F.expr("array_join(transform(split(text, '\n'), (l, i) -> concat('## Part ', i, '\n\n', l)), '\n\n')")
        return self.raw("documents").select(
            F.expr("concat('p', doc_id)").alias("id"), F.col("doc_id").cast("string").alias("document_id"), F.concat(body, F.lit("\n\n---\n\nChat with us")).alias("content_markdown"), F.expr("doc_id % 33 = 0").alias("deleted")
        )

    def chunks(self) -> DataFrame:
        """Vectors as the chunks of documents, five each."""
        kind = F.expr("case vec_id % 3 when 0 then 'transcript_window' when 1 then 'panel_section' else 'notes_paragraph' end")
        return self.raw("embeddings").select(F.col("vec_id").alias("chunk_id"), F.expr("cast(vec_id div 5 as string)").alias("document_id"), kind.alias("source_type"), F.col("embedding").alias("vector"), "label")


_E = "TIMESTAMP '2024-01-01 00:00:00'"
SQL = {
    "docs": rf"""docs AS (SELECT CAST(doc_id AS VARCHAR) AS id, array_to_string(regexp_extract_all(text, '[^ \n\t]+')[1:6], ' ') AS title,
    {_E} + to_days(CAST(doc_id % 365 AS INTEGER)) AS created_at, {_E} + to_days(CAST(doc_id % 365 AS INTEGER)) + to_hours(CAST(doc_id % 7 AS INTEGER)) AS updated_at,
    CASE WHEN doc_id % 17 = 0 THEN {_E} + to_days(CAST(doc_id % 365 + 1 AS INTEGER)) END AS deleted_at, source AS doc_type, text AS notes_plain FROM documents)""",
    "utts": f"""utts AS (SELECT conv_id || ':' || turn AS id, CAST(conv_id AS VARCHAR) AS document_id, turn AS seq,
    {_E} + to_days(CAST(conv_id % 365 AS INTEGER)) + to_seconds(turn * 30) AS start_timestamp, {_E} + to_days(CAST(conv_id % 365 AS INTEGER)) + to_seconds(turn * 30 + 5 + turn % 20) AS end_timestamp,
    text, CASE role WHEN 'user' THEN 'microphone' WHEN 'assistant' THEN 'system' END AS source, CASE WHEN role = 'assistant' AND conv_id % 4 > 0 THEN 'Speaker ' || (conv_id % 4) END AS speaker_name FROM conversations)""",
    "people": """people AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, 'c' || c_custkey || '@' || lower(c_mktsegment) || '.example' AS email, c_mktsegment AS company_name, 'nation ' || c_nationkey AS job_title FROM customer)""",
    "doc_people": """doc_people AS (SELECT CAST(o_orderkey // 15 AS VARCHAR) AS document_id, email, CASE WHEN o_custkey % 10 > 0 THEN name END AS full_name, CASE WHEN o_orderpriority LIKE '1%' THEN 'creator' ELSE 'attendee' END AS role
    FROM orders JOIN people ON CAST(o_custkey AS VARCHAR) = people.id)""",
    "cals": """cals AS (SELECT CAST(n_nationkey AS VARCHAR) AS id, r_name AS provider, n_nationkey % 5 = 0 AS "primary", n_name AS summary FROM nation JOIN region ON n_regionkey = r_regionkey)""",
    "evs": """evs AS (SELECT CAST(event_id AS VARCHAR) AS id, event_type AS summary, ts AS start_time, 'cal-' || (user_id % 25) AS calendar_id FROM events)""",
    "templates": """templates AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS title, p_type AS category, p_partkey % 11 = 0 AS deleted FROM part)""",
    "recipes": """recipes AS (SELECT CAST(p_partkey AS VARCHAR) AS id, lower(replace(p_name, ' ', '-')) || '-' || p_partkey AS slug, CASE p_partkey % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'user' ELSE 'shared' END AS visibility, p_partkey % 13 = 0 AS deleted FROM part)""",
    "panels": r"""panels AS (SELECT 'p' || doc_id AS id, CAST(doc_id AS VARCHAR) AS document_id, string_split(text, chr(10)) AS lines, doc_id % 33 = 0 AS deleted FROM documents)""",
    "chunks": """chunks AS (SELECT vec_id AS chunk_id, CAST(vec_id // 5 AS VARCHAR) AS document_id, CASE vec_id % 3 WHEN 0 THEN 'transcript_window' WHEN 1 THEN 'panel_section' ELSE 'notes_paragraph' END AS source_type, embedding AS vector, label FROM embeddings)""",
}


def with_(*names: str) -> str:
    """``WITH`` and the named views."""
    return "WITH " + ", ".join(SQL[n] for n in names)
