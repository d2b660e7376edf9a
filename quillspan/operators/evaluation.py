"""Retrieval quality: per-query scores, their means, strata, and wins between two rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def query_scores(results: DataFrame, labels: DataFrame, k: int = 10, documents: DataFrame | None = None) -> DataFrame:
    """query_id, best_rank, found, n_labels, hit, recall, rr of results (query_id, document_id, rank).

    labels: (query_id, label), ids; where by_id is false, titles, which any of ``documents`` (id, title) of that very title
    meets. best_rank looks at the whole list, the others at the first k.
    """
    found = results.select("query_id", "rank", F.col("document_id").alias("label"))
    if documents is not None:
        named = results.join(documents.select(F.col("id").alias("document_id"), "title"), "document_id")
        found = found.withColumn("by_id", F.lit(True)).unionByName(named.select("query_id", "rank", F.col("title").alias("label"), F.lit(False).alias("by_id")))
    on = [c for c in ("query_id", "label", "by_id") if c in found.columns]
    wanted = labels.select(*on).distinct()
    n = wanted.groupBy("query_id").agg(F.count("*").alias("n_labels"))
    met = found.join(wanted, on).select("query_id", "label", "rank")
    best = met.groupBy("query_id").agg(F.min("rank").alias("best_rank"), F.count_distinct(F.when(F.col("rank") <= k, F.col("label"))).alias("found"))
    return measured(n.join(best, "query_id", "left").withColumn("found", F.coalesce("found", F.lit(0).cast("long"))), k)


def measured(rows: DataFrame, k: int = 10) -> DataFrame:
    """hit, recall and rr of (query_id, best_rank, found, n_labels), as ``query_scores`` or ``semantic.standings`` give them."""
    hit = F.coalesce(F.col("best_rank") <= k, F.lit(False))
    return rows.select("query_id", "best_rank", "found", "n_labels", hit.cast("int").alias("hit"), (F.col("found") / F.col("n_labels")).alias("recall"), F.when(hit, 1.0 / F.col("best_rank")).otherwise(F.lit(0.0)).alias("rr"))


def _means() -> list:
    return [F.count("*").alias("n"), F.round(F.avg("hit"), 6).alias("hit_rate"), F.round(F.avg("recall"), 6).alias("mean_recall"), F.round(F.avg("rr"), 6).alias("mrr")]


def aggregate(scores: DataFrame) -> DataFrame:
    return scores.agg(*_means())


def by_stratum(scores: DataFrame, strata: DataFrame) -> DataFrame:
    """Means for each query_type of strata (query_id, query_type); without one it is ``unlabeled``."""
    rows = scores.join(strata, "query_id", "left").withColumn("query_type", F.coalesce("query_type", F.lit("unlabeled")))
    return rows.groupBy("query_type").agg(*_means())


def win_loss_tie(a: DataFrame, b: DataFrame) -> DataFrame:
    """Wins, losses and ties of a against b by best rank; a found label beats a missing one."""
    far = F.lit(2147483647)
    both = a.select("query_id", F.coalesce("best_rank", far).alias("ra")).join(b.select("query_id", F.coalesce("best_rank", far).alias("rb")), "query_id")
    return both.agg(F.count_if(F.expr("ra < rb")).alias("wins"), F.count_if(F.expr("ra > rb")).alias("losses"), F.count_if(F.expr("ra = rb")).alias("ties"))


def latency(times: DataFrame) -> DataFrame:
    """avg, p50, p95, p99, min, max milliseconds of runs (mode, ms), and runs a second."""
    p = lambda q: F.percentile("ms", q)
    return times.groupBy("mode").agg(F.avg("ms").alias("avg"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.min("ms").alias("min"), F.max("ms").alias("max"), (F.count("*") * 1000 / F.sum("ms")).alias("per_second"))
