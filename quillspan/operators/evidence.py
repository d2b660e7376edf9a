"""Evidence of a match: the places in a document that hold every part of a query, with their neighbours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.batches import small_batches
from quillspan.functions.text import excerpt, has_all, paragraphs, parse_query, sections, single_spaced, strip_footer

#: The order in which evidence is shown, and the defaults.
PRIORITY = {"panel": 0, "notes": 1, "transcript": 2}
MAX_MATCHES, MAX_CHARS, CONTEXT = 1, 160, 0

_SITE = ["document_id", "source", "outer", "inner", "text", "section", "speaker", "speaker_name", "timestamp", "before", "after"]


def _around(units: Column, i: Column, n: int) -> tuple[Column, Column]:
    """The n units on each side of unit i (0-based) of an array."""
    start = F.greatest(i - n, F.lit(0))
    none = F.slice(units, 1, 0)
    return (F.slice(units, start + 1, i - start), F.slice(units, i + 2, n)) if n else (none, none)


def panel_sites(panels: DataFrame, query: str, context: int = 0) -> DataFrame:
    """Sections of live panels whose body holds every part; neighbours are of the same panel.

    A body holds every part only if the panel does, so only such panels are cut into sections.
    """
    small_batches(panels.sparkSession)
    likely = panels.filter("not deleted").filter(has_all(F.col("content_markdown"), parse_query(query)))
    p = likely.select("document_id", F.col("id").alias("outer"), sections(strip_footer(F.col("content_markdown"))).alias("s"))
    bodies = F.transform("s", lambda x: single_spaced(x["body"]))
    rows = p.select("document_id", "outer", bodies.alias("units"), F.posexplode("s").alias("inner", "x"))
    before, after = _around(F.col("units"), F.col("inner"), context)
    hits = rows.filter(has_all(F.col("x.body"), parse_query(query)))
    return hits.select("document_id", F.lit("panel").alias("source"), "outer", "inner", F.col("x.body").alias("text"), F.col("x.heading").alias("section"), *_nulls(), before.alias("before"), after.alias("after"))


def _nulls() -> list[Column]:
    return [F.lit(None).cast("string").alias("speaker"), F.lit(None).cast("string").alias("speaker_name"), F.lit(None).cast("timestamp").alias("timestamp")]


def notes_sites(documents: DataFrame, query: str, context: int = 0, separator: str = "\n\n") -> DataFrame:
    likely = documents.filter(has_all(F.col("notes_plain"), parse_query(query)))
    p = likely.select(F.col("id").alias("document_id"), paragraphs(F.col("notes_plain"), separator).alias("p"))
    rows = p.select("document_id", F.transform("p", single_spaced).alias("units"), F.posexplode("p").alias("inner", "x"))
    before, after = _around(F.col("units"), F.col("inner"), context)
    hits = rows.filter(has_all(F.col("x"), parse_query(query)))
    return hits.select("document_id", F.lit("notes").alias("source"), F.lit("").alias("outer"), "inner", F.col("x").alias("text"), F.lit(None).cast("string").alias("section"), *_nulls(), before.alias("before"), after.alias("after"))


def transcript_sites(utterances: DataFrame, query: str, context: int = 0, speaker: Column | None = None) -> DataFrame:
    """Utterances that hold every part. Neighbours are taken before the query's and the speaker's filter, in documents with a hit."""
    w = Window.partitionBy("document_id").orderBy("start_timestamp", "seq")
    said = utterances.filter("text <> ''")
    u = said.join(said.filter(has_all(F.col("text"), parse_query(query))).select("document_id").distinct(), "document_id", "left_semi").withColumn("inner", F.row_number().over(w) - 1)
    unit = single_spaced(F.col("text"))
    none = F.array().cast("array<string>")
    before = F.collect_list(unit).over(w.rowsBetween(-context, -1)) if context else none
    after = F.collect_list(unit).over(w.rowsBetween(1, context)) if context else none
    rows = u.withColumn("before", before).withColumn("after", after)
    hits = rows.filter(has_all(F.col("text"), parse_query(query)))
    if speaker is not None:
        hits = hits.filter(speaker)
    return hits.select("document_id", F.lit("transcript").alias("source"), F.lit("").alias("outer"), "inner", "text", F.lit(None).cast("string").alias("section"), F.col("source").alias("speaker"), "speaker_name", F.col("start_timestamp").alias("timestamp"), "before", "after")


def all_sites(documents: DataFrame, panels: DataFrame, utterances: DataFrame, query: str, context: int = CONTEXT, speaker: Column | None = None, separator: str = "\n\n") -> DataFrame:
    """Sites of all sources; with a speaker only transcripts can be attributed. A query without parts has none."""
    said = transcript_sites(utterances, query, context, speaker)
    if not parse_query(query):
        return said.filter(F.lit(False))
    if speaker is not None:
        return said
    return reduce(DataFrame.unionByName, [panel_sites(panels, query, context).select(_SITE), notes_sites(documents, query, context, separator).select(_SITE), said.select(_SITE)])


def first_matches(sites: DataFrame, max_matches: int = MAX_MATCHES) -> DataFrame:
    """Sites with their place in the document's order (pos from 1), total, and whether they are shown."""
    order = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])[F.col("source")]
    w = Window.partitionBy("document_id").orderBy(order, "outer", "inner")
    whole = Window.partitionBy("document_id")
    return sites.withColumn("pos", F.row_number().over(w)).withColumn("total", F.count("*").over(whole)).withColumn("shown", F.col("pos") <= max_matches)


def remaining_sources(matches: DataFrame) -> DataFrame:
    """document_id, remaining: sources of sites that aren't shown, in display order."""
    order = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])[F.col("source")]
    left = matches.filter("not shown").groupBy("document_id").agg(F.array_sort(F.collect_set(F.struct(order.alias("o"), "source"))).alias("s"))
    return left.select("document_id", F.transform("s", lambda x: x["source"]).alias("remaining"))


def shape(page: DataFrame, sites: DataFrame, query: str, best_chunks: DataFrame | None = None, max_matches: int = MAX_MATCHES, max_chars: int = MAX_CHARS, context: int = CONTEXT, fallback: bool = True) -> DataFrame:
    """Cards for a page of documents (id, title, score...): lexical matches, else the best chunk, else the title.

    best_chunks: (document_id, source_type, chunk_text). With context the whole unit is shown.
    """
    small_batches(page.sparkSession)
    parts = parse_query(query)
    own = sites.join(page.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    placed = first_matches(own, max_matches)
    width = max_chars if not context else 1 << 30
    match = F.struct("source", excerpt(F.col("text"), parts, width).alias("excerpt"), "section", "speaker", "speaker_name", "timestamp", F.col("before").alias("context_before"), F.col("after").alias("context_after"))
    shown = placed.filter("shown").select("document_id", "pos", match.alias("m")).groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("matches"))
    totals = placed.groupBy("document_id").agg(F.max("total").alias("total_matches"))
    out = page.withColumn("document_id", F.col("id")).join(totals, "document_id", "left").join(shown, "document_id", "left").join(remaining_sources(placed), "document_id", "left")
    title = has_all(F.col("title"), parts) if parts else F.lit(False)
    out = out.withColumn("signal_title", title).withColumn("total_matches", F.coalesce("total_matches", F.lit(0).cast("long")))
    if best_chunks is not None:
        kind = F.when(F.col("source_type") == "transcript_window", "transcript").when(F.col("source_type") == "panel_section", "panel").when(F.col("source_type") == "notes_paragraph", "notes")
        best = best_chunks.select("document_id", kind.alias("chunk_source"), excerpt(F.col("chunk_text"), parts, max_chars).alias("chunk_excerpt"))
        out = out.join(best, "document_id", "left").withColumn("signal_semantic", F.col("chunk_source").isNotNull())
        use = (F.col("total_matches") == 0) & F.col("chunk_source").isNotNull() & F.lit(fallback)
        out = out.withColumn("chunk_evidence", F.when(use, F.struct(F.col("chunk_source").alias("source"), F.col("chunk_excerpt").alias("excerpt")))).withColumn("total_matches", F.when(use, F.lit(1).cast("long")).otherwise(F.col("total_matches"))).drop("chunk_source", "chunk_excerpt")
    return out.drop("document_id")
