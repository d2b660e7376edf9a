"""Benchmark decontamination: spaced seeds, joined on their hashes, and substitution-tolerant verification.

A seed is a run of words of which a fixed mask ignores some positions, so it survives a substituted word in
a position that one of the masks ignores. Seeds of the benchmark's items are sorted by hash; seeds of every
position of every document are looked up in them. Around each hit the item is laid over the document at
the hit's offset, and any stretch of ``least`` words or more (or the whole item, where that is shorter), of which
``threshold`` are equal, is a find. The best stretch that scores 1 for an equal word and -2 for another is looked at
first, as it ends where the copy does; where edits near an end make it too short, all stretches are.

The benchmark is taken in blocks of at most about ``block_words`` words, chosen by a hash of the item, and each
block is one pass over the documents: what is broadcast has a fixed bound whatever the benchmark's size (some 90 bytes
a word, 36 MB by default). With several blocks each pass is a job of its own that writes what it finds, and the finds
are joined to the rows by the digest of their text at the end, so no task holds more than one block and no plan grows.
The masks miss no item of 11 words or more at the default threshold. Of shorter ones those of less than seven words
are found word for word only, the others always word for word and with an edit if a mask ignores it. Items without
words find nothing.

Null and empty texts contain nothing; an empty benchmark finds nothing; an empty table gives an empty one.
Equal items are all reported. Equal rows have equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.scratch import Scratch, small_batches
from quillspan.llm.tokens import U, mix, pieces, word_hashes

#: Positions that count are 1: six or eight of seven to eleven words. In 11 to 14 words with two edits, 15 to 19 with three and
#: 20 with four, wherever these are, one of the masks finds a place that has no edit where it looks.
MASKS = ("1110111", "110101011", "11100000111", "11011011011")


def seeds(hashes: np.ndarray, first: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all seeds that lie in one row, and the word at which each starts."""
    span = len(mask)
    n = len(hashes) - span + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    weights = mix(np.arange(span, dtype=np.uint64) + U(len(mask) * 1000)) | U(1)
    h = np.zeros(n, dtype=np.uint64)
    for k, c in enumerate(mask):
        if c == "1":
            h += hashes[k : k + n] * weights[k]
    inside = np.ones(n, dtype=bool)
    for cut in range(1, span):
        at = first[1:-1] - cut
        inside[at[(at >= 0) & (at < n)]] = False
    at = np.flatnonzero(inside)
    return mix(h[at]), at


class Block:
    """One block of the benchmark: words of its items one after another, and their seeds by hash."""

    def __init__(self, ids: np.ndarray, words: list[np.ndarray]):
        self.ids = ids
        self.words = np.concatenate([*words, np.zeros(0, dtype=np.uint64)])
        self.first = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        short = sorted({len(w) for w in words if 0 < len(w) < min(map(len, MASKS))})
        self.masks = [*MASKS, *("1" * n for n in short)]
        found = []
        for mask in self.masks:
            h, at = seeds(self.words, self.first, mask)
            if mask not in MASKS:  # of short items only the whole
                item = np.searchsorted(self.first, at, side="right") - 1
                whole = (self.first[item] == at) & (self.first[item + 1] - at == len(mask))
                h, at = h[whole], at[whole]
            found.append((h, at))
        self.at = np.concatenate([a for _, a in found])
        h = np.concatenate([x for x, _ in found])
        order = np.argsort(h, kind="stable")
        self.hash, self.at = h[order], self.at[order]
        bits = max(16, min(25, (16 * max(1, len(h))).bit_length()))
        self.shift = U(64 - bits)
        self.maybe = np.zeros(1 << bits, dtype=bool)
        self.maybe[(self.hash >> self.shift).astype(np.int64)] = True

    def finds(self, hashes: np.ndarray, first: np.ndarray, least: int, threshold: float) -> dict[int, dict[int, int]]:
        """row -> item -> equal words of the best stretch."""
        out: dict[int, dict[int, int]] = {}
        tried = set()
        for mask in self.masks:
            h, at = seeds(hashes, first, mask)
            some = np.flatnonzero(self.maybe[(h >> self.shift).astype(np.int64)])
            lo, hi = np.searchsorted(self.hash, h[some], "left"), np.searchsorted(self.hash, h[some], "right")
            for p, a, b in zip(at[some[hi > lo]], lo[hi > lo], hi[hi > lo], strict=True):
                for q in self.at[a:b]:
                    item = int(np.searchsorted(self.first, q, side="right")) - 1
                    row = int(np.searchsorted(first, p, side="right")) - 1
                    if (row, item, p - q) in tried:  # this item at this offset in this row was seen
                        continue
                    tried.add((row, item, p - q))
                    n = self._stretch(hashes, first[row], first[row + 1], int(p) - int(q), item, least, threshold)
                    if n:
                        own = out.setdefault(row, {})
                        own[item] = max(own.get(item, 0), n)
        return out

    def _stretch(self, hashes: np.ndarray, lo: int, hi: int, offset: int, item: int, least: int, threshold: float) -> int:
        a, b = max(self.first[item], lo - offset), min(self.first[item + 1], hi - offset)
        same = self.words[a:b] == hashes[a + offset : b + offset]
        sums = np.concatenate([[0], np.cumsum(np.where(same, 1, -2))])
        low = np.minimum.accumulate(sums)
        end = int(np.argmax(sums - low))
        start = int(np.flatnonzero(sums[: end + 1] == low[end])[-1]) if end else 0
        equal = int(same[start:end].sum())
        need = min(least, int(self.first[item + 1] - self.first[item]))
        if end - start >= need and equal >= threshold * (end - start):
            return equal
        return _widest(same, need, threshold)


def _widest(same: np.ndarray, need: int, threshold: float) -> int:
    """Equal words of the longest stretch of ``need`` words or more of which ``threshold`` are equal; 0 if there is none."""
    if len(same) < need:
        return 0
    equal = np.concatenate([[0], np.cumsum(same)])
    value = equal - threshold * np.arange(len(equal))
    low = np.minimum.accumulate(value)
    # for each end, the first start from which enough words are equal: low only falls, so it is where low first is small enough
    start = np.searchsorted(-low, -value - 1e-9)
    size = np.arange(len(equal)) - start
    end = int(np.argmax(size))
    return int(equal[end] - equal[start[end]]) if size[end] >= max(1, need) else 0


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 13, threshold: float = 0.8, block_words: int = 400_000, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of every row, contaminated, n_items, items (sorted item_ids) and words (equal words of the longest find)."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.filter("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    # a word and what separates it take two characters at least
    size = items.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0
    blocks = max(1, -(-int(size) // block_words))
    text = F.lower(F.coalesce("text", F.lit("")))
    if blocks == 1:
        shared = _block(items)
        plain = ", ".join(f"`{docs.schema[c].name}` {docs.schema[c].dataType.simpleString()}" for c in keep)
        out = docs.select(*keep, text.alias("__text")).mapInArrow(_search(shared, keep, least, threshold), f"{plain}, __items array<long>, __words int")
    else:
        out = _in_passes(docs, items, text, blocks, least, threshold, keep)
    return out.select(*keep, F.col("__items").isNotNull().alias("contaminated"), F.coalesce("__items", F.array().cast("array<long>")).alias("items"), F.coalesce("__words", F.lit(0)).alias("words")).withColumn("n_items", F.size("items"))


def _in_passes(docs: DataFrame, items: DataFrame, text: Column, blocks: int, least: int, threshold: float, keep: tuple[str, ...]) -> DataFrame:
    """A job a block, which writes the texts that hold any of its items, by their digest: tasks hold one block at a time."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    schema = "__key string, __items array<long>, __words int"
    texts = docs.select(F.sha2(text, 256).alias("__key"), text.alias("__text"))
    for k in range(blocks):
        shared = _block(items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k))
        found = texts.mapInArrow(_search(shared, ("__key",), least, threshold), schema)
        scratch.keep(found.filter("__items is not null").dropDuplicates(["__key"]), "found")  # copies of a text find the same
        shared.destroy()
    whole = docs.sparkSession.read.schema(schema).parquet(f"{scratch.root}/*")  # one scan, however many blocks
    merged = whole.groupBy("__key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("__items")))).alias("__items"), F.max("__words").alias("__words"))
    return docs.select(*keep, F.sha2(text, 256).alias("__key")).join(merged, "__key", "left")


def _block(items: DataFrame) -> Broadcast:
    part = items.orderBy("item_id", "text").toPandas()  # a block's size is bounded
    words = []
    for lo, hi, data, offsets in pieces(pa.array(part["text"], pa.string())):
        h, first = word_hashes(data, offsets)
        words += [h[first[i] : first[i + 1]] for i in range(hi - lo)]
    return items.sparkSession.sparkContext.broadcast(Block(part["item_id"].to_numpy(dtype=np.int64), words))


def _search(shared: Broadcast, keep: tuple[str, ...], least: int, threshold: float):
    """``keep`` columns of every row, and items and words of those whose ``__text`` holds items of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            found: list[list[int] | None] = [None] * batch.num_rows
            most = [0] * batch.num_rows
            for lo, _, data, offsets in pieces(batch.column("__text")):
                hashes, first = word_hashes(data, offsets)
                for row, own in block.finds(hashes, first, least, threshold).items():
                    found[lo + row] = sorted({int(block.ids[i]) for i in own})
                    most[lo + row] = max(own.values())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found, pa.list_(pa.int64())), pa.array(most, pa.int32())], names=[*keep, "__items", "__words"])

    return run
