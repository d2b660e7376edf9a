"""The user's commands as plans: grep, search, list, show, with."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.dates import DateRange
from quillspan.operators import evidence, fusion, rerank, search, semantic, sinks, transcripts


def grep(documents: DataFrame, panels: DataFrame, utterances: DataFrame, sources: dict[str, DataFrame], query: str, targets: tuple[str, ...] | None = None, speaker: str | None = None, limit: int = 10, matches: int = 1, context: int = 0, dates: DateRange = DateRange(), meeting: str | None = None, include_deleted: bool = False, separator: str = "\n\n") -> tuple[DataFrame, DataFrame]:
    """(page of cards, total of meetings). A speaker's matches are looked for in all results before the page is cut."""
    if speaker is not None and targets is not None and "transcripts" not in targets:
        raise ValueError("a speaker can be asked for in transcripts only")
    found = search.search(documents, sources, query, targets, include_deleted, dates, meeting)
    w = Window.orderBy(F.col("score").asc(), F.col("created_at").desc(), F.col("id").asc())
    test = None
    if speaker is not None:
        names = None if speaker.lower() in ("me", "other") else transcripts.resolve_names(utterances, speaker)
        test = F.col("source") == ("microphone" if speaker.lower() == "me" else "system") if names is None else F.lower("speaker_name").isin([n.lower() for n in names])
    sites = evidence.all_sites(documents, panels, utterances, query, context, test, separator)
    if speaker is not None:
        found = found.join(sites.select(F.col("document_id").alias("id")).distinct(), "id", "left_semi")
    total = found.agg(F.count("*").alias("total_meetings"))
    ordered = found.orderBy(F.col("score").asc(), F.col("created_at").desc(), F.col("id").asc())
    page = (ordered.limit(limit) if limit else ordered).withColumn("pos", F.row_number().over(w))  # a page
    return evidence.shape(page, sites, query, None, matches, context=context), total


def hybrid_search(documents: DataFrame, sources: dict[str, DataFrame], chunks: DataFrame, query: str, vector: list[float], score=None, min_score: float | None = None, dates: DateRange = DateRange(), meeting: str | None = None, limit: int = 10, targets: tuple[str, ...] | None = None, include_deleted: bool = False) -> DataFrame:
    """Ranked documents of the keyword and the vector search; ``score`` reranks the pool, None is the fast way."""
    spark = documents.sparkSession
    if score is None and min_score is not None:
        raise ValueError("a least score needs a reranker")
    kw = search.search(documents, sources, query, targets, include_deleted, dates, meeting).limit(fusion.POOL)
    w = Window.orderBy(F.col("score").asc(), F.col("created_at").desc(), F.col("id").asc())
    keyword = kw.select(F.lit(0).alias("query_id"), F.col("id").alias("document_id"), F.row_number().over(w).alias("rank"))  # of a pool
    allowed = documents.filter(search.in_range(F.col("created_at"), dates))
    if not include_deleted:
        allowed = allowed.filter("deleted_at is null")
    if meeting is not None:
        allowed = allowed.filter(F.contains(F.lower("title"), F.lit(meeting.lower())) | F.contains(F.lower("id"), F.lit(meeting.lower())))
    q = spark.createDataFrame([(0, [float(x) for x in vector])], "query_id int, q array<double>")
    near = semantic.search(chunks, q, allowed.select("id"), semantic.source_filter(targets), limit=fusion.POOL)
    fused = fusion.hybrid(keyword, near.select("query_id", "document_id", "rank"))
    if score is None:
        out = fused.join(documents.select(F.col("id").alias("document_id"), "title", "created_at"), "document_id").withColumn("score", F.lit(None).cast("double")).withColumn("position", F.col("fused_rank"))
    else:
        text = near.join(chunks.select("chunk_id", F.col("text").alias("chunk_text")), "chunk_id").select("query_id", "document_id", "chunk_text") if "text" in chunks.columns else near.select("query_id", "document_id", F.lit(None).cast("string").alias("chunk_text"))
        series = fusion.title_series(documents)
        known = documents.join(series, F.lower(F.trim("title")) == F.col("title_key"), "left").withColumn("n_series", F.coalesce("n_series", F.lit(1)))
        signals = known.select(F.col("id").alias("document_id"), fusion.title_signal(query, F.col("title"), F.col("n_series")).alias("s"))
        out = rerank.rerank(fused.join(signals, "document_id"), documents, text, score, lambda _: F.col("s"), min_score)
    return out.orderBy("position").limit(limit) if limit else out.orderBy("position")


PAGE = "id string, title string, created_at timestamp, score double, pos int"


def search_page(documents: DataFrame, panels: DataFrame, utterances: DataFrame, sources: dict[str, DataFrame], chunks: DataFrame, query: str, vector: list[float], limit: int = 10, score=None, min_score: float | None = None, matches: int = 1, context: int = 0, dates: DateRange = DateRange(), meeting: str | None = None, targets: tuple[str, ...] | None = None, include_deleted: bool = False, separator: str = "\n\n") -> tuple[DataFrame, DataFrame]:
    """(page of cards, keyword_total) of a hybrid search, in two phases: first the page, then its evidence.

    The page's ids (at most ``limit``) are literals in the second plan, so the scans of panels, notes, utterances and chunks
    leave out all other documents before anything is cut or scored. Each card has the best chunk of its document, of
    those that only the keyword search found too. keyword_total is of all keyword hits, beyond pool and page.
    """
    if limit < 1:
        raise ValueError("a page has at least one document")
    ranked = hybrid_search(documents, sources, chunks, query, vector, score, min_score, dates, meeting, limit, targets, include_deleted)
    rows = [(r["document_id"], r["title"], r["created_at"], r["score"], k + 1) for k, r in enumerate(ranked.select("document_id", "title", "created_at", "score", "position").orderBy("position").collect())]
    ids = [r[0] for r in rows]
    spark = documents.sparkSession
    page = spark.createDataFrame(rows, PAGE)
    hits = search.search(documents, sources, query, targets, include_deleted, dates, meeting)
    near = chunks.filter(F.col("document_id").isin(ids))
    q = spark.createDataFrame([(0, [float(x) for x in vector])], "query_id int, q array<double>")
    best = semantic.best_scored(near, q, semantic.source_filter(targets)).select("document_id", "chunk_id", "source_type")
    text = chunks.filter(F.col("document_id").isin(ids)).select("chunk_id", F.col("text").alias("chunk_text")) if "text" in chunks.columns else None
    best = best.withColumn("chunk_text", F.lit(None).cast("string")) if text is None else best.join(text, "chunk_id")
    own = lambda df, c: df.filter(F.col(c).isin(ids))
    sites = evidence.all_sites(own(documents, "id"), own(panels, "document_id"), own(utterances, "document_id"), query, context, separator=separator)
    cards = evidence.shape(page, sites, query, best, matches, context=context)
    found = hits.select("id").filter(F.col("id").isin(ids)).withColumn("signal_keyword", F.lit(True))
    cards = cards.join(found, "id", "left").withColumn("signal_keyword", F.coalesce("signal_keyword", F.lit(False)))
    chosen = best.select(F.col("document_id").alias("id"), F.col("chunk_id").alias("best_chunk"))
    return cards.join(chosen, "id", "left"), search.keyword_total(hits)


def search_envelope(page: DataFrame, total: DataFrame, query: str, limit: int) -> DataFrame:
    """One row: query, keyword_total, limit, returned and the page's cards in order."""
    return sinks.envelope(page, total, query, limit, "keyword_total")
