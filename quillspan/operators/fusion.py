"""Hybrid ranking: reciprocal-rank fusion of ranked lists, title signals and the ordering score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.text import content_words, plain_title

#: Fixed values of the ranking.
RRF_K, POOL, RERANK_POOL = 60, 100, 50
PRIOR_WEIGHT, TITLE_WEIGHT = 30.0, 0.2


def pool(ranked: DataFrame, size: int = POOL) -> DataFrame:
    return ranked.filter(F.col("rank") <= size)


def rrf(lists: DataFrame) -> DataFrame:
    """query_id, document_id, rrf, best_rank, fused_rank of (query_id, list, document_id, rank) rows.

    A document that a list holds twice counts once, at its best rank.
    """
    once = lists.groupBy("query_id", "list", "document_id").agg(F.min("rank").alias("rank"))
    fused = once.groupBy("query_id", "document_id").agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("rrf"), F.min("rank").alias("best_rank"))
    w = Window.partitionBy("query_id").orderBy(F.round("rrf", 12).desc(), "best_rank", "document_id")
    return fused.withColumn("fused_rank", F.row_number().over(w))


def hybrid(keyword: DataFrame, semantic: DataFrame, size: int = POOL) -> DataFrame:
    """Fused pools of a keyword and a semantic ranking (query_id, document_id, rank)."""
    a = pool(keyword, size).select("query_id", F.lit("keyword").alias("list"), "document_id", "rank")
    b = pool(semantic, size).select("query_id", F.lit("semantic").alias("list"), "document_id", "rank")
    return rrf(a.unionByName(b))


def title_series(documents: DataFrame) -> DataFrame:
    """title_key and how many live documents share it; blank titles don't count."""
    return documents.filter("deleted_at is null").select(plain_title(F.col("title")).alias("title_key")).filter("title_key <> ''").groupBy("title_key").agg(F.count("*").alias("n_series"))


def title_signal(query: str, title: Column, series: Column) -> Column:
    """Share of the query's content words in the title, less for titles of a long series."""
    q = content_words(F.lit(query))
    share = F.size(F.array_intersect(q, content_words(title))) / F.size(q)
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(share / F.log2(1 + series))


def ordering(candidates: DataFrame, prior: float = PRIOR_WEIGHT, title: float = TITLE_WEIGHT) -> DataFrame:
    """order_score of (score or null, rrf, title_signal): it orders, the score shown stays as it is."""
    return candidates.withColumn("order_score", F.coalesce("score", F.lit(0.0)) + prior * F.col("rrf") + title * F.col("title_signal"))
