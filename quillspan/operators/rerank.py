"""Reranking a fused pool with a pluggable scorer of (query, passage)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.operators.fusion import RERANK_POOL, ordering

Scorer = Callable[[str, list[str]], list[float]]


def passage(title: Column, chunk: Column) -> Column:
    """Title and chunk with a blank line between; either may be missing."""
    return F.concat_ws("\n\n", F.when(title != "", title), chunk)


def count_score(query: str) -> Callable[[Column], Column]:
    """The stand-in scorer: how often the query stands in the passage, without regard to case."""
    q = query.lower()

    def score(text: Column) -> Column:
        low = F.lower(F.coalesce(text, F.lit("")))
        return ((F.length(low) - F.length(F.replace(low, F.lit(q), F.lit("")))) / len(q)).cast("double")

    return score


def model_score(query: str, make: Callable[[], Scorer], batch: int = 16) -> Callable[[Column], Column]:
    """A scorer that each Python worker makes once; a sigmoid puts its logits on 0 to 1."""

    def score(text: Column) -> Column:
        held: list[Scorer] = []

        @F.pandas_udf("double")
        def run(s: pd.Series) -> pd.Series:
            if not held:
                held.append(make())
            texts = s.fillna("").tolist()
            out = [x for k in range(0, len(texts), batch) for x in held[0](query, texts[k : k + batch])]
            return 1 / (1 + (-pd.Series(out, index=s.index, dtype="float64")).map(__import__("math").exp))

        return run(text)

    return score


def rerank(fused: DataFrame, documents: DataFrame, chunks: DataFrame, score: Callable[[Column], Column], signal: Callable[[Column], Column], min_score: float | None = None) -> DataFrame:
    """The best of the pool scored and put in order. chunks: (query_id, document_id, chunk_text).

    Documents that aren't known drop out; one without a chunk is scored by its title.
    """
    few = fused.filter(F.col("fused_rank") <= RERANK_POOL)
    rows = few.join(documents.select(F.col("id").alias("document_id"), "title"), "document_id").join(chunks, ["query_id", "document_id"], "left")
    rows = rows.withColumn("score", score(passage(F.col("title"), F.col("chunk_text")))).withColumn("title_signal", signal(F.col("title")))
    if min_score is not None:
        rows = rows.filter(F.col("score") >= min_score)
    w = Window.partitionBy("query_id").orderBy(F.round("order_score", 9).desc(), "fused_rank")
    return ordering(rows).withColumn("position", F.row_number().over(w))
