"""Embedding: a pluggable model over batches, failures kept apart, and the watermark rule."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], list[np.ndarray]]


def byte_embedder(dim: int = 768) -> Embedder:
    """The stand-in model: bytes, as fractions of 255, summed at their place modulo dim, then normalised."""

    def one(text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode(), dtype=np.uint8) / 255.0
        v = np.bincount(np.arange(len(raw)) % dim, raw, dim) if len(raw) else np.zeros(dim)
        n = np.linalg.norm(v)
        return (v / n if n else v).astype(np.float32)

    return lambda texts: [one(t) for t in texts]


def embed(chunks: DataFrame, make: Callable[[], Embedder] = byte_embedder, batch: int = 16) -> DataFrame:
    """source_type, source_id, vector, error: a batch that fails gives its error and no vectors, others go on."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in frames:
            texts = (pdf["header"].fillna("") + pdf["text"].fillna("")).tolist()
            vectors: list = []
            errors: list = []
            for k in range(0, len(texts), batch):
                part = texts[k : k + batch]
                try:
                    vectors += [v.tolist() for v in model(part)]
                    errors += [None] * len(part)
                except Exception as e:  # noqa: BLE001  a model's errors are its own
                    vectors += [None] * len(part)
                    errors += [str(e)] * len(part)
            yield pd.DataFrame({"source_type": pdf["source_type"], "source_id": pdf["source_id"], "vector": vectors, "error": errors})

    rows = chunks if "header" in chunks.columns else chunks.withColumn("header", F.lit(None).cast("string"))
    return rows.select("source_type", "source_id", "header", "text").mapInPandas(run, "source_type string, source_id string, vector array<float>, error string")


def watermark(results: DataFrame, stamp: str | None) -> str | None:
    """The sync stamp that the index may claim: none if any batch failed."""
    return None if not results.filter("error is not null").isEmpty() else stamp


def matches_model(metadata: DataFrame, model: str, dim: int) -> bool:
    """Whether stored vectors are of this model; if not they must all go."""
    kept = {r["key"]: r["value"] for r in metadata.filter(F.col("key").isin("model_name", "embedding_dim")).collect()}
    return kept in ({}, {"model_name": model, "embedding_dim": str(dim)})


def tokens_over(chunks: DataFrame, limit: int = 2048) -> DataFrame:
    return chunks.filter(F.length("text") > limit)
