"""Exact vector search that skips: chunks in cells around centres, and bounds on the cosine by the triangle inequality.

Chunks are dealt to the nearest of some centres, and written in a folder for each. A cell knows the least and the greatest
angle between its vectors and its centre, so for a query at some angle from the centre no vector of the cell is nearer than
the difference of the angles. A search scores the cells nearest to each query first, takes each query's k-th score, and then
reads only cells whose bound reaches it for some query: the answer is that of ``semantic.search`` over all chunks.

Centres come from a bounded sample (the vectors of least hash) and are bounded in number; they and the cells' angles are all
that the driver holds. Chunks without a vector of the index's length, and zero or non-finite ones, are a cell of their own
that is always read. How much is skipped depends on the vectors: it is nothing where they are spread evenly in many dimensions.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators import semantic
from quillspan.sources.commits import Commits

#: Bounds of the number of centres and of the sample, parts that a cell's rows are dealt over, and what angles may be off by.
MOST_CELLS, SAMPLE, SPREAD, OFF = 4096, 20_000, 8, 1e-7
CELLS = "cell int, centre array<double>, n long, least double, most double"


def centres(vectors: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centres of unit vectors, by spherical k-means from evenly spaced rows."""
    found = vectors[np.linspace(0, len(vectors) - 1, min(k, len(vectors))).astype(int)]
    for _ in range(rounds):
        of = np.argmax(vectors @ found.T, axis=1)
        total = np.zeros_like(found)
        np.add.at(total, of, vectors)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        found = np.where(size > 1e-12, total / np.maximum(size, 1e-12), found)
    return found


def bounds(queries: np.ndarray, centre: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The greatest cosine that each unit query can have with a vector of each cell."""
    angle = np.arccos(np.clip(queries @ centre.T, -1, 1))
    return np.cos(np.clip(np.maximum(angle - most, least - angle) - OFF, 0, math.pi))


class VectorIndex:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.commits = spark, root.rstrip("/"), Commits(spark, root)

    def build(self, chunks: DataFrame, dim: int | None = None, cells: int | None = None) -> int:
        """Index chunks (document_id, chunk_id, source_type, vector). dim: the vectors' length, the most frequent one if not given."""
        sizes = chunks.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).filter("d > 0").orderBy(F.col("n").desc(), "d")
        common = sizes.first()
        dim = dim or (common["d"] if common else 1)
        cells = min(MOST_CELLS, cells or 1 + math.isqrt(common["n"] if common else 0))
        drawn = chunks.filter(F.size("vector") == dim).select("vector").orderBy(F.xxhash64("vector")).limit(SAMPLE).toPandas()["vector"]
        sample = np.array([np.asarray(v, dtype=np.float64) for v in drawn]).reshape(-1, dim)
        size = np.linalg.norm(sample, axis=1)
        sample = sample[np.isfinite(size) & (size > 0)]
        middle = centres(sample / np.linalg.norm(sample, axis=1, keepdims=True), cells) if len(sample) else np.zeros((0, dim))
        n, _ = self.commits.head()
        folder = f"v{n + 1:06d}-{uuid.uuid4().hex[:8]}"
        plain = chunks.select("document_id", F.col("chunk_id").cast("long").alias("chunk_id"), "source_type", F.col("vector").cast("array<double>").alias("vector"))
        placed = plain.mapInArrow(_placer(self.spark.sparkContext.broadcast(middle)), "document_id string, chunk_id long, source_type string, vector array<double>, cell int, angle double")
        placed.repartition("cell", F.pmod(F.xxhash64("chunk_id"), F.lit(SPREAD))).write.partitionBy("cell").parquet(f"{self.root}/{folder}/chunks")
        schema = "document_id string, chunk_id long, source_type string, vector array<double>, angle double, cell int"
        stored = self.spark.read.schema(schema).parquet(f"{self.root}/{folder}/chunks")
        per = {r["cell"]: r for r in stored.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("least"), F.max("angle").alias("most")).collect()}
        rows = [(c, [float(x) for x in middle[c]] if c >= 0 else [], r["n"], r["least"], r["most"]) for c, r in per.items()]
        self.spark.createDataFrame(rows, CELLS).coalesce(1).write.parquet(f"{self.root}/{folder}/cells")
        self.commits.commit(n + 1, {"folder": folder, "dim": dim})
        return n + 1

    def chunks(self, cells: list[int] | None = None) -> DataFrame:
        """Indexed chunks; of some cells, only their folders are read."""
        schema = "document_id string, chunk_id long, source_type string, vector array<double>, angle double, cell int"
        df = self.spark.read.schema(schema).parquet(f"{self.root}/{self.commits.head()[1]['folder']}/chunks")
        return (df if cells is None else df.filter(F.col("cell").isin(cells))).drop("angle", "cell")

    def search(self, queries: DataFrame, allowed: DataFrame | None = None, sources: list[str] | None = None, min_score: float = 0.0, limit: int | None = None) -> tuple[DataFrame, dict[str, int]]:
        """``semantic.search`` over the indexed chunks for at most ``semantic.MOST_QUERIES`` queries, and what it reads."""
        head = self.commits.head()[1]
        cells = self.spark.read.schema(CELLS).parquet(f"{self.root}/{head['folder']}/cells").toPandas()
        own = cells[cells["cell"] >= 0].reset_index(drop=True)
        loose = cells.loc[cells["cell"] < 0, "cell"].tolist()
        asked = queries.select("query_id", F.col("q").cast("array<double>").alias("q")).limit(semantic.MOST_QUERIES + 1).collect()
        if len(asked) > semantic.MOST_QUERIES:
            raise ValueError(f"at most {semantic.MOST_QUERIES} queries at once")
        fit = [r for r in asked if r["q"] is not None and len(r["q"]) == head["dim"]]
        total = int(cells["n"].sum())
        if not fit or not len(own):
            return semantic.search(self.chunks(), queries, allowed, sources, min_score, limit), {"cells": len(cells), "cells_read": len(cells), "chunks": total, "chunks_read": total}
        vectors = np.array([r["q"] for r in fit], dtype=np.float64)
        size = np.linalg.norm(vectors, axis=1, keepdims=True)
        unit = vectors / np.where(size == 0, 1, size)
        middle = np.array(own["centre"].tolist())
        counts, least, most = own["n"].to_numpy(), own["least"].to_numpy(), own["most"].to_numpy()
        ceiling = np.concatenate([bounds(unit[i : i + 1000], middle, least, most) for i in range(0, len(unit), 1000)])
        ceiling[size[:, 0] == 0] = 0.0  # a zero query scores 0 with everything
        floor = np.full(len(fit), float(min_score))
        if limit:
            order = np.argsort(-ceiling, axis=1, kind="stable")
            enough = np.cumsum(counts[order], axis=1) >= 4 * limit
            upto = np.where(enough.any(axis=1), enough.argmax(axis=1), len(own) - 1)
            near = sorted({int(own["cell"][c]) for row, last in zip(order, upto) for c in row[: last + 1]})
            first = semantic.search(self.chunks(near + loose), queries, allowed, sources, min_score, limit)
            kth = {r["query_id"]: r["score"] for r in first.filter(F.col("rank") == limit).select("query_id", "score").collect()}
            floor = np.array([max(f, kth.get(r["query_id"], f)) for f, r in zip(floor, fit)])
        needed = (ceiling >= floor[:, None] - 1e-9).any(axis=0)
        read = [int(c) for c in own.loc[needed, "cell"]] + loose
        report = {"cells": len(cells), "cells_read": len(read), "chunks": total, "chunks_read": int(cells.loc[cells["cell"].isin(read), "n"].sum())}
        return semantic.search(self.chunks(read), queries, allowed, sources, min_score, limit), report


def _placer(shared):
    names = ["document_id", "chunk_id", "source_type", "vector", "cell", "angle"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = shared.value
        for batch in batches:
            cell, angle = np.full(batch.num_rows, -1, dtype=np.int32), np.full(batch.num_rows, np.nan)
            lengths = batch.column("vector").value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            fits = np.flatnonzero(lengths == middle.shape[1])
            if len(fits) and len(middle):
                flat = batch.column("vector").take(pa.array(fits)).flatten()
                v = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fits), -1)
                size = np.linalg.norm(v, axis=1)
                good = np.isfinite(size) & (size > 0)
                cosine = (v[good] / size[good, None]) @ middle.T
                best = np.argmax(cosine, axis=1)
                cell[fits[good]] = best
                angle[fits[good]] = np.arccos(np.clip(cosine[np.arange(len(best)), best], -1, 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:4]), pa.array(cell), pa.array(angle)], names=names)

    return run
