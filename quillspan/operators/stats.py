"""Counts and sizes of the stored tables, one aggregate for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.text import estimated_tokens

MAX_CHARS, SMALL_CHARS = 2048, 50


def database_info(documents: DataFrame, utterances: DataFrame, panels: DataFrame, people: DataFrame, calendars: DataFrame, events: DataFrame, templates: DataFrame, recipes: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row of totals. Documents without transcripts are total less with, which foreign transcripts can make negative."""
    parts = [
        documents.agg(F.count_if(F.col("deleted_at").isNull()).alias("documents"), F.count_if(F.col("deleted_at").isNotNull()).alias("deleted_documents"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest")),
        utterances.agg(F.count("*").alias("utterances"), F.count_distinct("document_id").alias("documents_with_transcripts")),
        panels.agg(F.count_if(~F.col("deleted")).alias("panels"), F.count_distinct(F.when(~F.col("deleted"), F.col("document_id"))).alias("documents_with_panels")),
        people.agg(F.count("*").alias("people"), F.count_distinct("company_name").alias("companies")),
        calendars.agg(F.count("*").alias("calendars")),
        events.agg(F.count("*").alias("events")),
        templates.agg(F.count_if(~F.col("deleted")).alias("templates")),
        recipes.agg(F.count_if(~F.col("deleted")).alias("recipes")),
        chunks.agg(F.count("*").alias("chunks")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out.withColumn("documents_without_transcripts", F.col("documents") - F.col("documents_with_transcripts"))


def sync_stats(documents: DataFrame, utterances: DataFrame, panels: DataFrame) -> DataFrame:
    d = documents.agg(F.count("*").alias("documents"), F.max("updated_at").alias("last_update"))
    return d.crossJoin(utterances.agg(F.count("*").alias("utterances"))).crossJoin(panels.agg(F.count("*").alias("panels")))


def count_panels(panels: DataFrame) -> DataFrame:
    return panels.filter("not deleted").agg(F.count("*").alias("panels"))


def at_percentile(sizes: Column, p: int) -> Column:
    """The element nearest to percentile p of a sorted array, halves rounded up; no interpolation."""
    return F.element_at(sizes, F.floor((F.size(sizes) - 1) * p / 100 + F.lit(0.5)).cast("int") + 1)


def size_stats(chunks: DataFrame) -> DataFrame:
    """Sizes of chunks by source: n, total, avg, min, max, median, p10, p90, p99, over, small.

    Sizes are counted first, so what is sorted in one place has a row for each size and not for each chunk.
    """
    counts = chunks.select("source_type", F.length("text").alias("size")).groupBy("source_type", "size").agg(F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("size", "n")))
    grouped = counts.groupBy("source_type").agg(
        F.sum("n").alias("n_chunks"), F.sum(F.col("n") * F.col("size")).alias("total"), F.min("size").alias("min_size"), F.max("size").alias("max_size"), F.sum(F.when(F.col("size") > MAX_CHARS, F.col("n")).otherwise(0)).alias("over"), F.sum(F.when(F.col("size") < SMALL_CHARS, F.col("n")).otherwise(0)).alias("small"), ordered.alias("s")
    )

    def nth(i: Column) -> Column:
        """The size at 0-based place i."""
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("found"))
        step = lambda acc, x: F.struct((acc["seen"] + x["n"]).alias("seen"), F.coalesce(acc["found"], F.when(acc["seen"] + x["n"] > i, x["size"])).alias("found"))
        return F.aggregate("s", start, step, lambda acc: acc["found"])

    place = lambda p: F.floor((F.col("n_chunks") - 1) * p / 100 + F.lit(0.5))
    half = F.floor(F.col("n_chunks") / 2)
    median = F.when(F.col("n_chunks") % 2 == 1, nth(half)).otherwise(F.floor((nth(half - 1) + nth(half)) / 2)).cast("int")
    return grouped.select("source_type", "n_chunks", F.round(F.col("total") / F.col("n_chunks"), 6).alias("avg_size"), "min_size", "max_size", median.alias("median"), nth(place(10)).alias("p10"), nth(place(90)).alias("p90"), nth(place(99)).alias("p99"), estimated_tokens(F.col("total")).alias("tokens"), "over", "small")


def embedding_status(chunks: DataFrame, embedded: DataFrame) -> DataFrame:
    """source_type, total, embedded, pending: of chunks, those whose id has a vector."""
    ids = embedded.select("chunk_id").distinct().withColumn("has", F.lit(1))
    rows = chunks.select("chunk_id", "source_type").join(ids, "chunk_id", "left")
    return rows.groupBy("source_type").agg(F.count("*").alias("total"), F.count("has").alias("embedded"), F.count_if(F.col("has").isNull()).alias("pending"))


def newest_stamp(metadata: DataFrame) -> DataFrame:
    """The latest readable last_sync stamp of what chunks are made from."""
    kinds = ["last_sync_documents", "last_sync_transcripts", "last_sync_panels"]
    rows = metadata.filter(F.col("key").isin(kinds)).withColumn("at", F.try_to_timestamp("value")).filter("at is not null")
    return rows.agg(F.max_by("value", "at").alias("stamp"))


def freshness(metadata: DataFrame, n_vectors: int, model: str, chunking: dict[str, str]) -> str:
    """Empty, ModelMismatch, LegacyChunking, Stale or Fresh, by the index's own notes (a few rows)."""
    kept = {r["key"]: r["value"] for r in metadata.limit(1000).collect()}
    if not n_vectors:
        return "Empty"
    if kept.get("model_name") != model:
        return "ModelMismatch"
    if any(kept.get(k) != v for k, v in chunking.items()):
        return "LegacyChunking"
    newest = newest_stamp(metadata).first()["stamp"]
    if newest is not None:
        ahead = metadata.sparkSession.createDataFrame([(newest, kept.get("embedded_sync_watermark"))], "newest string, mark string")
        if ahead.filter("mark is null or try_to_timestamp(newest) > try_to_timestamp(mark)").count():
            return "Stale"
    return "Fresh"
