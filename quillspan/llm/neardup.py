"""MinHash near-duplicates: BagMinHash signatures, banding, and verified multiset overlap.

A document is the multiset of its five-word shingles (lower-cased words; the whole of a text of one to four
words is one shingle). Every shingle carries a Poisson process for each dyadic interval of its count,
(0,1], (1,2], (2,4] and so on: points have a rising hash value, a component of the signature and, in the
last and partly covered interval, a level that the count must reach. A component keeps its least
point, so two documents agree in it with the probability of their weighted Jaccard similarity. Points are
made only up to a bound that fills all components: the work is in proportion to shingles and components.

25 bands of 6 components find a pair of similarity 0.8 with probability 0.9995. Equal multisets are collapsed
first. All members of a bucket are compared with its head, the smallest doc_id, which is the same in most buckets
of a group. Two members that still are in different components can't share more of their head than either of
them does, and nothing else but what both have beyond it: only pairs for which this sum may reach the
threshold are compared in full, so no link between members of a bucket is lost, and a group of n near
copies costs about n comparisons, not n * n / 2.

Texts without words link with nothing. Equal texts link. Rows of one doc_id are one document: its texts count as linked
and one of its rows is kept. Rows without an id are judged by their text, rows of equal text being one document; their
component is that of the linked documents with ids, else null, and one of the group is kept all the same. Ids under 2**62
are looked for. Tables without rows give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.components import components
from quillspan.llm.scratch import IdFilter, Scratch
from quillspan.llm.tokens import U, grams, mix, pieces, word_hashes

SHINGLE = 5
BANDS, ROWS = 25, 6
SIZE = BANDS * ROWS


def bags(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hash, count, row) of the distinct shingles of each row, by row and hash."""
    hashes, first = word_hashes(data, offsets)
    g, before = grams(hashes, first, SHINGLE)
    row = np.repeat(np.arange(len(before) - 1), np.diff(before))
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    new = np.ones(len(g), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return g[at], np.diff(np.append(at, len(g))), row[at]


_STEP = U(0x9E3779B97F4A7C15)


def _unit(h: np.ndarray) -> np.ndarray:
    return ((h >> U(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


def signatures(g: np.ndarray, count: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """sig[row, component]: the 64-bit name of the least point; 0 in rows without shingles."""
    weight = np.bincount(row, count, rows)
    # one process for each shingle and dyadic interval that its count reaches into
    top = np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64)
    of = np.repeat(np.arange(len(g)), top + 1)
    k = np.arange(len(of)) - np.repeat(np.cumsum(top + 1) - (top + 1), top + 1)
    low = np.where(k > 0, 2.0 ** (k - 1), 0.0)
    width = np.where(k > 0, low, 1.0)
    seed = mix(g[of] + mix(k.astype(np.uint64) + U(77)))
    owner = row[of]
    reach = count[of]
    value = np.full(rows * SIZE, np.inf)
    name = np.zeros(rows * SIZE, dtype=np.uint64)
    bound = (np.log(SIZE) + 3.0) / np.maximum(weight, 1)  # fills all components in 19 of 20 rows
    x = np.zeros(len(of))
    step = np.zeros(len(of), dtype=np.uint64)
    partial = bool((count > 1).any())
    alive = np.arange(len(of))
    while len(alive):
        live = alive
        while len(live):
            # few processes are left in short rows only, which need many points each: take several at once
            block = int(min(512, max(1, 16_384 // len(live))))
            h = mix((seed[live] + step[live] * _STEP)[:, None] + np.arange(block, dtype=np.uint64) * _STEP)
            step[live] += U(block)
            points = x[live][:, None] + np.cumsum(-np.log(_unit(h)), axis=1) / (SIZE * width[live])[:, None]
            x[live] = points[:, -1]
            near = points <= bound[owner[live]][:, None]
            who_of = np.repeat(live, near.sum(axis=1))
            h, v = h[near], points[near]
            live = live[near[:, -1]]
            h2 = mix(h ^ U(0x5851F42D4C957F2D))
            if partial:
                ok = low[who_of] + width[who_of] * _unit(mix(h2 ^ U(0x14057B7EF767814F))) <= reach[who_of]
                who_of, h, v, h2 = who_of[ok], h[ok], v[ok], h2[ok]
            at = owner[who_of] * SIZE + (h2 % U(SIZE)).astype(np.int64)
            better = v < value[at]
            at, v, h = at[better], v[better], h[better]
            order = np.argsort(-v, kind="stable")  # the least is put last
            at = at[order]
            value[at], name[at] = v[order], h[order] | U(1)
        open_rows = np.isinf(value.reshape(rows, SIZE)).any(axis=1) & (weight > 0)
        alive = np.flatnonzero(open_rows[owner])
        if len(alive):
            bound = np.where(open_rows, bound * 2, bound)
            # start again in the rows that weren't filled
            x[alive] = 0
            step[alive] = 0
    return name.reshape(rows, SIZE)


def band_keys(sig: np.ndarray) -> np.ndarray:
    weights = mix(np.arange(3, 3 + ROWS, dtype=np.uint64)) | U(1)
    folded = (sig.reshape(len(sig), BANDS, ROWS) * weights).sum(axis=2, dtype=np.uint64)
    return mix(folded + mix(np.arange(BANDS, dtype=np.uint64) + U(1000)))


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row's band keys, and two sums that name its multiset; rows without words are left out."""
    for batch in batches:
        for lo, hi, data, offsets in pieces(batch.column("text"), 1 << 18):
            g, count, row = bags(data, offsets)
            first = np.searchsorted(row, np.arange(hi - lo))
            some = np.flatnonzero(np.bincount(row, minlength=hi - lo))
            keys = band_keys(signatures(g, count, row, hi - lo)[some]).astype(np.int64)
            member = mix(g * U(0x9FB21C651E98DF25) + count.astype(np.uint64))
            names = [np.add.reduceat(m, first[some]).astype(np.int64) for m in (member, mix(member ^ U(0x5851F42D4C957F2D)))] if len(some) else [np.zeros(0, dtype=np.int64)] * 2
            ids = batch.column("doc_id").slice(lo, hi - lo).take(pa.array(some))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(names[0]), pa.array(names[1]), lists], names=["doc_id", "m1", "m2", "keys"])


def _members(candidates: IdFilter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted 32-bit hashes of (shingle, which time it occurs), of documents that may be candidates."""
        for batch in batches:
            batch = batch.filter(pa.array(candidates(batch.column("h").to_numpy())))
            for lo, hi, data, offsets in pieces(batch.column("text")):
                g, count, row = bags(data, offsets)
                of = np.repeat(np.arange(len(g)), count)
                nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                m = (mix(g[of] + nth.astype(np.uint64) * U(0xD6E8FEB86659FD93)) >> U(32)).astype("<u4")
                cut = np.searchsorted(row[of], np.arange(hi - lo + 1))
                own = [np.unique(m[cut[i] : cut[i + 1]]).tobytes() for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(own, pa.binary())], names=["doc_id", "members"])

    return run


NAMELESS = 1 << 62


def node(doc_id: Column, text: Column) -> Column:
    """A document's number: its doc_id; above all ids, a digest of the text where there is none."""
    return F.coalesce(doc_id.cast("long"), F.xxhash64(text).bitwiseAND(F.lit(NAMELESS - 1)) + F.lit(NAMELESS))


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row for each of ``docs``: doc_id, component_id (smallest doc_id reachable by links), kept."""
    nth = groups(docs, threshold).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    shown = lambda c: F.when(F.col(c) < NAMELESS, F.col(c))
    return nth.select(shown("node").alias("doc_id"), shown("component").alias("component_id"), ((F.col("node") == F.col("component")) & (F.col("nth") == 1)).alias("kept"))


def groups(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row a document: node, n (its rows), component (smallest node reachable by links)."""
    scratch = Scratch(docs.sparkSession, "neardup")
    texts = docs.select(node(F.col("doc_id"), F.col("text")).alias("doc_id"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    bands = scratch.keep(texts.mapInArrow(_banded, "doc_id long, m1 long, m2 long, keys array<long>"), "bands")
    # one of equal multisets stands for all
    classes = scratch.keep(bands.groupBy("m1", "m2").agg(F.min("doc_id").alias("rep")), "classes")
    exploded = bands.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("doc_id", F.explode("keys").alias("key"))
    # the member that the others of a bucket are compared with is the least: mostly the same in a group's buckets
    crowded = scratch.keep(exploded.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("head")).filter("n > 1").select("key", "head"), "crowded")
    pairs = scratch.keep(exploded.join(crowded, "key").filter("doc_id <> head").select("doc_id", "head").distinct(), "pairs")
    ids = scratch.keep(pairs.select("doc_id").union(pairs.select("head")).distinct(), "ids")
    candidates = IdFilter(ids, "doc_id")
    bag = scratch.keep(texts.withColumn("h", F.xxhash64("doc_id")).mapInArrow(_members(candidates), "doc_id long, members binary").join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("members").alias("members")), "bags")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whether x and y are linked, x's size, their common members, and x's other members."""
        for batch in batches:
            linked, size, both, other = [], [], [], []
            for x, y in zip(batch.column("mx"), batch.column("my"), strict=True):
                a, b = np.frombuffer(x.as_py(), "<u4"), np.frombuffer(y.as_py(), "<u4")
                own = np.isin(a, b, assume_unique=True, kind="sort")
                n = int(own.sum())
                linked.append(n >= threshold * (len(a) + len(b) - n))
                size.append(len(a))
                both.append(n)
                other.append(a[~own].view("<i4"))
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), pa.array(linked, pa.bool_()), pa.array(size, pa.int32()), pa.array(both, pa.int32()), pa.array(other, pa.list_(pa.int32()))], names=["x", "y", "linked", "size", "both", "other"])

    def compared(pairs: DataFrame) -> DataFrame:
        left = pairs.join(bag.select(F.col("doc_id").alias("x"), F.col("members").alias("mx")), "x")
        both = left.join(bag.select(F.col("doc_id").alias("y"), F.col("members").alias("my")), "y")
        return scratch.keep(both.select("x", "y", "mx", "my").mapInArrow(verify, "x long, y long, linked boolean, size int, both int, other array<int>"), "compared")

    tested = compared(pairs.toDF("x", "y"))
    links = tested.filter("linked").select(F.col("x").alias("a"), F.col("y").alias("b"))
    labels = components(scratch, links)
    # members of one head in different components: y can share with x no more of the head than either does,
    # and besides only what both have beyond it; few pairs can still reach the threshold
    named = tested.select(F.col("y").alias("head"), F.col("x").alias("id"), "size", "both", "other").join(labels, "id", "left").withColumn("c", F.coalesce("component", "id"))
    mixed = named.groupBy("head").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("head")
    named = scratch.keep(named.join(mixed, "head", "left_semi").select("head", "id", "size", "both", "other", "c"), "mixed")
    p, q = (named.select("head", *[F.col(c).alias(f"{c}_{side}") for c in ("id", "size", "both", "other", "c")]) for side in "pq")
    need = F.lit(threshold / (1 + threshold)) * (F.col("size_p") + F.col("size_q")) - F.least("both_p", "both_q") - 1e-6
    may = (F.col("c_p") < F.col("c_q")) & (F.least(F.size("other_p"), F.size("other_q")) >= need)
    may = may & F.when(need <= 0, True).otherwise(F.size(F.array_intersect("other_p", "other_q")) >= need)
    open_pairs = p.join(q, (p["head"] == q["head"]) & may).select(F.col("id_p").alias("x"), F.col("id_q").alias("y")).distinct()
    more = compared(open_pairs).filter("linked").select(F.col("x").alias("a"), F.col("y").alias("b"))
    labels = components(scratch, links.union(more))
    rows = bands.select("doc_id", "m1", "m2").join(classes, ["m1", "m2"]).join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("c"))
    every = texts.groupBy("doc_id").agg(F.count("*").alias("n")).join(rows.groupBy("doc_id").agg(F.min("c").alias("c")), "doc_id", "left")
    return every.select(F.col("doc_id").alias("node"), "n", F.coalesce("c", "doc_id").alias("component"))
