"""Embedding near-dedup: collision-counting projections.

Vectors are projected on many one-dimensional lines, each the sum of one direction of each of two sets, so that
there are 32 times as many lines as vectors at the cost of the square root; of three sets, at the cost of
the cube root, where two would need more than ``WIDEST`` directions each (from half a million vectors on). A
vector is listed on the lines on which it is projected furthest out. All lists are sorted by projection at once, in ranges
that tasks hold in blocks; a list that a block's end cuts is joined with its other blocks. Around each vector, a window
of its list is a set of collisions, collisions are counted per pair over all lists, and pairs that reach the
count are verified by their cosine in double precision. The number of lists a vector is put on and the
count are calibrated on random pairs exactly at the threshold, for a recall of ``recall``.

Lists have a bounded length for vectors that are not alike, whatever their number, so the pairs to
count grow with the vectors. Equal vectors are collapsed first and stand for all their copies.

Vectors that are null, empty, all zero or hold null or non-finite components link with nothing. Vectors of
different lengths don't link. A table without rows gives none. Null ids are dropped.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.components import components
from quillspan.llm.scratch import Scratch


WIDEST = 4096
MOST = 256


class Lines:
    """The sum lines of ``sets`` seeded sets of ``side`` directions, for vectors of one length."""

    def __init__(self, dim: int, side: int, lists: int, threshold: float, sets: int = 2, seed: int = 11):
        rng = np.random.default_rng([seed, dim])
        self.sets = [rng.standard_normal((dim, side)) / np.sqrt(sets) for _ in range(sets)]
        self.side, self.lists = side, lists
        self.top = min(side, max(4, int(np.ceil(lists ** (1 / sets) * 2))))
        self.window = 2.0 * np.sqrt(2 - 2 * threshold)

    def of(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(line, projection) of the ``lists`` lines on which each row is furthest out."""
        lines, sums = np.zeros((len(unit), 1), dtype=np.int64), np.zeros((len(unit), 1))
        for directions in self.sets:
            p = unit @ directions
            i = np.argpartition(-p, self.top - 1, axis=1)[:, : self.top]
            sums = (sums[:, :, None] + np.take_along_axis(p, i, 1)[:, None, :]).reshape(len(unit), -1)
            lines = (lines[:, :, None] * self.side + i[:, None, :]).reshape(len(unit), -1)
            k = min(self.lists, sums.shape[1])  # no other sum of these sets can be in one of the best of all
            best = np.argpartition(-sums, k - 1, axis=1)[:, :k]
            lines, sums = np.take_along_axis(lines, best, 1), np.take_along_axis(sums, best, 1)
        return lines, sums


def calibrate(dim: int, n: int, threshold: float, recall: float, pairs: int = 3000) -> tuple[int, int, int, int]:
    """(sets, side, lists, count): the fewest lists and then the greatest count that reach the recall at the threshold."""
    sets = 2 if 32 * n <= WIDEST**2 else 3
    side = max(8, int(np.ceil((32 * n) ** (1 / sets))))
    rng = np.random.default_rng(5)
    x = rng.standard_normal((pairs, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((pairs, dim))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
    y = threshold * x + np.sqrt(1 - threshold**2) * y if dim > 1 else x
    for lists in (8, 12, 16, 24, 32, 48, 64, 96, 128, 192, MOST):
        lines = Lines(dim, side, lists, threshold, sets)
        (lx, vx), (ly, vy) = lines.of(x), lines.of(y)
        near = (lx[:, :, None] == ly[:, None, :]) & (np.abs(vx[:, :, None] - vy[:, None, :]) <= lines.window)
        hits = near.sum(axis=(1, 2))
        reached = [c for c in range(1 if lists == MOST else 2, 9) if (hits >= c).mean() >= recall]
        if reached:
            return sets, side, lists, max(reached)
    warnings.warn(f"vectors of length {dim}: {(hits >= 1).mean():.3f} of pairs at the threshold are met, not {recall}", stacklevel=2)
    return sets, side, lists, 1


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 1))


PAIRS = 1 << 18
_BLOCK = "dims array<int>, lines array<long>, vals array<double>, reps array<long>"
_MET = "a long, b long, need int"


def _blocks(at_once: int):
    names = ("dim", "line", "value", "rep")

    def block(columns: list[np.ndarray]) -> pa.RecordBatch:
        dim, line = columns[:2]
        new = np.flatnonzero((dim[1:] != dim[:-1]) | (line[1:] != line[:-1])) + 1
        ends = [(0, new[0]), (new[-1], len(dim))] if len(new) else [(0, len(dim))]
        parts = [pa.array([c[lo:hi] for lo, hi in [(0, len(dim)), *ends]]) for c in columns]
        return pa.RecordBatch.from_arrays([*parts, pa.array([False] + [True] * len(ends))], names=["dims", "lines", "vals", "reps", "edge"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sorted rows of a partition in blocks; a block's first and last list, which other blocks may hold too, once more as edges."""
        held: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                hi = min(batch.num_rows, lo + at_once - rows)
                held.append([batch.column(c).to_numpy()[lo:hi] for c in names])
                rows, lo = rows + hi - lo, hi
                if rows == at_once:
                    yield block([np.concatenate(c) for c in zip(*held, strict=True)])
                    held, rows = [], 0
        if rows:
            yield block([np.concatenate(c) for c in zip(*held, strict=True)])

    return run


def _pairs(x: np.ndarray, y: np.ndarray, first: np.ndarray, last: np.ndarray, need: np.ndarray) -> Iterator[pa.RecordBatch]:
    """x[i] with y[first[i]:last[i]], a bounded number at once; ``need`` is x[i]'s."""
    width = np.maximum(last - first, 0)
    ends = np.cumsum(width)
    lo = 0
    while lo < len(x):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, side="right")))
        w = width[lo:hi]
        i = np.repeat(np.arange(lo, hi), w)
        p, q = x[i], y[np.repeat(first[lo:hi] - (np.cumsum(w) - w), w) + np.arange(len(i))]
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q)), pa.array(need[i])], names=["a", "b", "need"])
        lo = hi


def _within(widths: dict[int, float], needs: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of one block that stand in one list, no further apart than the window."""
        for batch in batches:
            for dims, lines, vals, reps in zip(*[batch.column(c) for c in ("dims", "lines", "vals", "reps")], strict=True):
                dim, line, value, rep = (c.values.to_numpy() for c in (dims, lines, vals, reps))
                new = np.concatenate([[0], np.cumsum((dim[1:] != dim[:-1]) | (line[1:] != line[:-1]))])
                far = np.array([widths[d] for d in dim.tolist()])
                # lists in a row on one axis, further apart than any window reaches
                axis = value + new * (value.max() - value.min() + 2 * far.max() + 1)
                last = np.searchsorted(axis, axis + far, side="right")
                need = np.array([needs[d] for d in dim.tolist()], dtype=np.int32)
                yield from _pairs(rep, rep, np.arange(1, len(rep) + 1), last, need)

    return run


def _across(widths: dict[int, float], needs: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of one list that stand in two of its blocks, no further apart than the window."""
        for batch in batches:
            for dim, vx, rx, vy, ry in zip(*[batch.column(c) for c in ("dim", "v_x", "r_x", "v_y", "r_y")], strict=True):
                d = dim.as_py()
                v, w = vx.values.to_numpy(), vy.values.to_numpy()
                first, last = np.searchsorted(w, v - widths[d], side="left"), np.searchsorted(w, v + widths[d], side="right")
                yield from _pairs(rx.values.to_numpy(), ry.values.to_numpy(), first, last, np.full(len(v), needs[d], dtype=np.int32))

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.98, at_once: int = 1024) -> DataFrame:
    """vec_id, n_links (other vectors of cosine >= threshold), component_id (smallest vec_id reachable), kept."""
    scratch = Scratch(vectors.sparkSession, "embeddings")
    usable = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = scratch.keep(
        vectors.filter("vec_id is not null").select(
            F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(usable, F.lit(False)).alias("usable"), F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(1), "embedding").alias("k2"), F.when(usable, F.col("embedding").cast("array<double>")).alias("embedding")
        ),
        "rows",
    )
    classes = scratch.keep(rows.filter("usable").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")), "classes")
    sizes = {r["dim"]: r["n"] for r in classes.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).collect()}
    plans = {dim: calibrate(dim, n, threshold, recall) for dim, n in sizes.items()}

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Lines] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                sets, side, lists, _ = plans[int(dim)]
                if int(dim) not in made:
                    made[int(dim)] = Lines(int(dim), side, lists, threshold, sets)
                lines = made[int(dim)]
                own = batch.filter(pa.array(dims == dim))
                for lo in range(0, own.num_rows, 1024):
                    part = own.slice(lo, 1024)
                    x = _matrix(part.column("embedding"))
                    x = x / np.abs(x).max(axis=1, keepdims=True)
                    line, value = lines.of(x / np.linalg.norm(x, axis=1, keepdims=True))
                    columns = [np.full(line.size, dim, dtype=np.int32), line.ravel(), value.ravel(), np.repeat(part.column("rep").to_numpy(), line.shape[1])]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["dim", "line", "value", "rep"])

    lists = classes.select("rep", F.size("embedding").alias("dim"), "embedding").mapInArrow(listed, "dim int, line long, value double, rep long")
    order = ("dim", "line", "value", "rep")
    # ranges of (list, projection): a list of many alike vectors is dealt over many tasks
    blocks = lists.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_blocks(at_once), f"{_BLOCK}, edge boolean")
    blocks = scratch.keep(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")
    widths = {dim: Lines(dim, 1, 1, threshold).window for dim in plans}
    needs = {dim: plan[3] for dim, plan in plans.items()}
    within = blocks.filter("not edge").mapInArrow(_within(widths, needs), _MET)
    ends = blocks.filter("edge").select(F.element_at("dims", 1).alias("dim"), F.element_at("lines", 1).alias("line"), "block", F.col("vals").alias("v"), F.col("reps").alias("r"))
    x, y = (ends.select("dim", "line", *[F.col(c).alias(f"{c}_{side}") for c in ("block", "v", "r")]) for side in "xy")
    width = F.create_map(*[F.lit(z) for pair in widths.items() for z in pair])[F.col("dim")] if widths else F.lit(0.0)
    meet = (F.element_at("v_y", 1) <= F.element_at("v_x", -1) + width) & (F.element_at("v_x", 1) <= F.element_at("v_y", -1) + width)
    neighbours = x.join(y, ["dim", "line"]).filter((F.col("block_x") < F.col("block_y")) & meet)
    across = neighbours.repartition("block_x", "block_y").mapInArrow(_across(widths, needs), _MET)
    counted = within.union(across).groupBy("a", "b").agg(F.count("*").alias("hits"), F.first("need").alias("need")).filter("hits >= need").select("a", "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = batch.column("u"), batch.column("v")
            long = np.diff(u.offsets.to_numpy())
            sure = np.zeros(batch.num_rows, dtype=bool)
            for dim in np.unique(long):
                at = np.flatnonzero(long == dim)
                p, q = _matrix(u.take(pa.array(at))), _matrix(v.take(pa.array(at)))
                p, q = p / np.abs(p).max(axis=1, keepdims=True), q / np.abs(q).max(axis=1, keepdims=True)  # no overflow of squares
                dot, pp, qq = (np.einsum("ij,ij->i", s, t) for s, t in ((p, q), (p, p), (q, q)))
                sure[at] = dot / np.sqrt(pp * qq) >= threshold
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(sure))

    pairs = counted.join(classes.select(F.col("rep").alias("a"), F.col("embedding").alias("u")), "a").join(classes.select(F.col("rep").alias("b"), F.col("embedding").alias("v")), "b")
    links = scratch.keep(pairs.select("a", "b", "u", "v").mapInArrow(verify, "a long, b long"), "links")
    labels = components(scratch, links)
    copies = classes.select(F.col("rep").alias("other"), "copies")
    degree = links.union(links.select("b", "a")).toDF("rep", "other").join(copies, "other").groupBy("rep").agg(F.sum("copies").alias("linked"))
    known = (
        classes.select("k1", "k2", "rep", "copies")
        .join(degree, "rep", "left")
        .join(labels.withColumnRenamed("id", "rep"), "rep", "left")
        .select("k1", "k2", F.lit(True).alias("usable"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).cast("long").alias("n"), F.coalesce("component", "rep").alias("c"))
    )
    out = rows.select("vec_id", "usable", "k1", "k2").join(known, ["k1", "k2", "usable"], "left")
    return out.select("vec_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_links"), F.coalesce("c", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))
