"""Suffix-array dedup: common-prefix-aware distributed merge sort of sampled suffixes.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else too. Bytes of strings of
``report`` bytes that do are counted beside (n_repeated) and stay. Sorting the suffixes at
all bytes would move every text hundreds of times, so suffixes are sampled: a place is an anchor if its
100-byte string has the least hash of some window of report - 99 places. What is chosen in a window depends
on the window alone, so every copy of a string of ``report`` bytes or more holds the same anchor at the same
distance, and no repeat can be missed.

1. Anchors whose 100-byte string stands once in the corpus are dropped, as nothing can repeat there. Where
   all that can matter around an anchor (300 bytes before, 400 after) is equal to another anchor's
   surroundings, every string over the anchor repeats. Both are counts by hash.
2. One anchor of each other kind of surroundings is left: the edges of repeats. Tasks sort the suffixes
   that start there into runs, front-code each run (the length of the prefix shared with the suffix
   before it, and the rest) and send the runs to partitions by the anchor's 100 bytes. There, loser
   trees merge the runs; each suffix carries the length of the prefix that it shares with the last
   winner, so shared prefixes are never compared again and the merge yields the prefix array of the
   sorted suffixes. The texts before the anchors, read backwards, are sent and merged in the same way.
3. For each number of bytes before the anchor, two anchors' strings are equal if no shared prefix between
   them, on either side, is too short: a scan of both prefix arrays.

An anchor with more than ``most`` different surroundings isn't gathered: for it, the hashes of all its
strings are counted by Spark. Hashes have 64 bits; equal hashes are taken as equal strings in step 1, which decides
most removals, and in that case; strings are compared byte by byte in step 2.

Null and empty texts have 0 bytes. Texts shorter than ``length`` lose nothing. A repeated row is a repeat: its
text goes whole if it is long enough. Rows are told apart by doc_id and text, so ids may be null or have several
texts. A table without rows gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.scratch import IdFilter, Scratch
from quillspan.llm.tokens import U, Hashes, mix, pieces
from quillspan.llm.windows import minimizers

GRAM = 100


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, hash of its GRAM bytes, hash of its surroundings) of all anchors, by row and place."""
    size = np.diff(offsets)
    count = np.where(size >= shortest, size - GRAM + 1, 0)
    before = np.concatenate([[0], np.cumsum(count)])
    if not before[-1]:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    hashes = Hashes(data)
    start = np.repeat(offsets[:-1] - before[:-1], count) + np.arange(before[-1])
    at = minimizers(hashes.of(start, start + GRAM), before, shortest - GRAM + 1)
    row = np.searchsorted(before, at, side="right") - 1
    place = at - before[row]
    here = offsets[row] + place
    left = np.maximum(here - (length - GRAM), offsets[row])
    right = np.minimum(here + length, offsets[row + 1])
    around = mix(hashes.of(left, right) + mix((here - left).astype(np.uint64)))
    return row, place, hashes.of(here, here + GRAM), around


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    n = min(len(a), len(b))
    for step in (128, 32, 8, 2, 1):
        while known + step <= n and a[known : known + step] == b[known : known + step]:
            known += step
    return known


def merge(runs: list[Iterator[tuple[bytes, int, int]]]) -> Iterator[tuple[bytes, int, int]]:
    """Merge sorted runs of (suffix, prefix shared with the one before it in the run, payload) by a loser tree.

    Yields (suffix, prefix shared with the one yielded before, payload). A player's ``lcp`` is the prefix it
    shares with the winner it lost to or, at a leaf, with the last winner of its own run: all on a path
    share theirs with the same string, so unequal lcps decide without a look at the bytes.
    """
    k = 1
    while k < max(1, len(runs)):
        k *= 2
    heads: list[bytes | None] = [None] * k
    payload, lcp = [0] * k, [0] * k

    def pull(r: int) -> None:
        item = next(runs[r], None) if r < len(runs) else None
        heads[r], lcp[r], payload[r] = item if item is not None else (None, 0, 0)

    def beats(x: int, y: int) -> bool:
        """Whether x wins; the loser's lcp is put against the winner."""
        a, b = heads[x], heads[y]
        if b is None:
            return True
        if a is None:
            return False
        if lcp[x] != lcp[y]:
            return lcp[x] > lcp[y]
        n = shared(a, b, lcp[x])
        first = len(a) == n or (len(b) != n and a[n] < b[n])
        if len(a) == n and len(b) == n:
            first = x < y
        lcp[y if first else x] = n
        return first

    for r in range(k):
        pull(r)
        lcp[r] = 0
    losers = [0] * k
    winners = list(range(k))
    level = k
    nodes = {k + r: r for r in range(k)}
    while level > 1:
        for node in range(level // 2, level):
            x, y = nodes[2 * node], nodes[2 * node + 1]
            nodes[node], losers[node] = (x, y) if beats(x, y) else (y, x)
        level //= 2
    winner = nodes.get(1, winners[0])
    while heads[winner] is not None:
        yield heads[winner], lcp[winner], payload[winner]
        pull(winner)
        node = (k + winner) // 2
        while node >= 1:
            if not beats(winner, losers[node]):
                winner, losers[node] = losers[node], winner
            node //= 2


def front_coded(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(shared prefixes, lengths of the rests, the rests) of sorted strings."""
    lcp = np.zeros(len(strings), dtype="<u2")
    rests, last = [], b""
    for i, s in enumerate(strings):
        lcp[i] = shared(last, s) if i else 0
        rests.append(s[lcp[i] :])
        last = s
    return lcp, np.array([len(x) for x in rests], dtype="<u2"), b"".join(rests)


def decoded(lcp: bytes, sizes: bytes, rests: bytes, base: int) -> Iterator[tuple[bytes, int, int]]:
    """A run again, with payloads counted from ``base``."""
    at, last = 0, b""
    for i, (n, size) in enumerate(zip(np.frombuffer(lcp, "<u2").tolist(), np.frombuffer(sizes, "<u2").tolist(), strict=True)):
        last = last[:n] + rests[at : at + size]
        at += size
        yield last, n, base + i


def resolve(right_lcp: np.ndarray, right_size: np.ndarray, left_rank: np.ndarray, left_lcp: np.ndarray, left_size: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) number of bytes before each anchor with which a string of ``length`` repeats; -1 if none does.

    Anchors are in the order of their suffixes; left_rank is each one's place in the order of the texts
    before them, and the prefix arrays belong to the two orders.
    """
    n = len(right_lcp)
    least, most = np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    for j in range(length - GRAM + 1):
        ok = np.flatnonzero((right_size >= length - j) & (left_size >= j))
        if len(ok) < 2:
            continue
        right = np.cumsum(right_lcp < length - j)[ok]
        left = np.cumsum(left_lcp < j)[left_rank[ok]] if j else np.zeros(len(ok), dtype=np.int64)
        both = right * np.int64(n + 1) + left
        order = np.argsort(both, kind="stable")
        s = both[order]
        twin = np.zeros(len(s), dtype=bool)
        twin[1:] = s[1:] == s[:-1]
        twin[:-1] |= s[:-1] == s[1:]
        hit = ok[order[twin]]
        least[hit] = np.where(least[hit] < 0, j, least[hit])
        most[hit] = j
    return least, most


def _lists(values: list[np.ndarray], cut: np.ndarray) -> list[pa.Array]:
    return [pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(v)) for v in values]


def _runs(lo: np.ndarray, hi: np.ndarray, size: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of what the spans cover, of those that have ``least`` bytes inside the text; a start below 0 is none."""
    lo, hi = lo[lo >= 0], np.minimum(hi[lo >= 0], size)
    lo, hi = lo[hi - lo >= least], hi[hi - lo >= least]
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order], np.maximum.accumulate(hi[order])
    new = np.flatnonzero(np.concatenate([[True], lo[1:] > reach[:-1]]))
    return lo[new], reach[np.append(new[1:], len(lo)) - 1]


def dedup(docs: DataFrame, length: int = 400, report: int = 280, most: int = 50_000, run_bytes: int = 8 << 20) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated. 100 <= report <= length < 65536."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffixes")
    before, early = length - GRAM, report - GRAM
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("doc_id", "text").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = rows.select("doc_id", "text")

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch.column("text")):
                row, place, h, around = anchors(data, offsets, length, report)
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *_lists([place.astype(np.int32), h.astype(np.int64), around.astype(np.int64)], cut)], names=["doc_id", "at", "h", "around"])

    lists = scratch.keep(texts.mapInArrow(anchored, "doc_id long, at array<int>, h array<long>, around array<long>"), "anchors")
    found = lists.select("doc_id", F.explode(F.arrays_zip("at", "h", "around")).alias("a")).select("doc_id", F.col("a.at").alias("at"), F.col("a.h").alias("h"), F.col("a.around").alias("around"))
    # written, so that both sides of the join are plain shuffles, of which Spark splits a hot key's
    kinds = scratch.keep(found.groupBy("h").agg(F.count("*").alias("n"), F.min("around").alias("lo"), F.max("around").alias("hi")).filter("n > 1"), "kinds")
    # rows of a frequent string are dealt over several keys
    salts = F.least(F.floor(F.col("n") / 2000) + 1, F.lit(1000)).cast("long").alias("salts")
    repeated = scratch.keep(found.join(kinds.select("h", (F.col("lo") != F.col("hi")).alias("open"), salts), "h").select("doc_id", "at", "h", "around", "open", "salts"), "repeated")

    # texts that may lose something
    ids = scratch.keep(repeated.select("doc_id").distinct(), "ids")
    wanted = IdFilter(ids, "doc_id")

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(wanted(batch.column("h").to_numpy()))).select(["doc_id", "text"])

    sub = scratch.keep(texts.withColumn("h", F.xxhash64("doc_id")).mapInArrow(chosen, "doc_id long, text string"), "texts")

    # anchors with twin surroundings: all strings over them repeat. Counted by salted key first, so no task gets a frequent string's rows
    opened = repeated.filter("open").withColumn("salt", F.pmod(F.xxhash64("doc_id", "at"), "salts"))
    parts = scratch.keep(opened.groupBy("h", "around", "salt").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "at")).alias("r")), "parts")
    classes = scratch.keep(parts.groupBy("h", "around").agg(F.sum("n").alias("n"), F.min("r").alias("r")).select("h", "around", "n", F.col("r.doc_id").alias("doc_id"), F.col("r.at").alias("at")), "classes")
    crowd = scratch.keep(classes.groupBy("h").agg(F.count("*").alias("kinds")).filter(F.col("kinds") > most).select("h"), "crowd")
    shared_by_many = parts.join(classes.filter("n > 1").select("h", "around"), ["h", "around"], "left_semi").select("h", "around", "salt")
    twins = opened.join(shared_by_many, ["h", "around", "salt"], "left_semi").select("doc_id", "at")
    from_ = lambda n: F.greatest(F.col("at") - n, F.lit(0)).cast("long")
    to = lambda n: (F.col("at") + n).cast("long")
    whole = repeated.filter("not open").select("doc_id", "at").union(twins).select("doc_id", from_(before).alias("lo"), to(length).alias("hi"), from_(early).alias("rlo"), to(report).alias("rhi"))

    few = classes.join(crowd, "h", "left_anti")
    targets = max(1, min(20_000, -(-few.count() // 10_000)))
    asked = few.groupBy("doc_id").agg(F.collect_list(F.struct("at", F.pmod("h", F.lit(targets)).cast("int").alias("target"))).alias("q"))

    names = ["target", "lcp", "sizes", "rests", "left_lcp", "left_sizes", "left_rests", "left", "docs", "at"]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted, front-coded runs for each target of about ``run_bytes`` of text."""

        def flush(held: list[tuple[int, bytes, bytes, int, int]]) -> Iterator[pa.RecordBatch]:
            held.sort()
            cut = [0, *(i for i in range(1, len(held)) if held[i][0] != held[i - 1][0]), len(held)]
            rows = []
            for lo, hi in zip(cut, cut[1:], strict=False):
                own = held[lo:hi]
                left = sorted(range(len(own)), key=lambda i: own[i][2])
                both = [x for coded in (front_coded([x[1] for x in own]), front_coded([own[i][2] for i in left])) for x in (coded[0].tobytes(), coded[1].tobytes(), coded[2])]
                rows.append((own[0][0], *both, np.array(left, dtype="<i4").tobytes(), np.array([x[3] for x in own], dtype="<i8").tobytes(), np.array([x[4] for x in own], dtype="<i4").tobytes()))
            types = [pa.int32(), *[pa.binary()] * 9]
            for k in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 64], strict=True), types, strict=True)], names=names)

        held, size = [], 0
        for batch in batches:
            for doc, text, q in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("q").to_pylist(), strict=True):
                for x in q:
                    at = x["at"]
                    right, left = text[at : at + length], text[max(0, at - before) : at][::-1]
                    held.append((x["target"], right, left, doc, at))
                    size += len(right) + len(left) + 100
                if size > run_bytes:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    def merged(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sizes = [len(x) // 2 for x in rows["lcp"]]
        base = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        streams = [decoded(a, b, c, n) for a, b, c, n in zip(rows["lcp"], rows["sizes"], rows["rests"], base, strict=False)]
        lefts = [decoded(a, b, c, n) for a, b, c, n in zip(rows["left_lcp"], rows["left_sizes"], rows["left_rests"], base, strict=False)]
        places = np.concatenate([np.frombuffer(x, "<i4") + n for x, n in zip(rows["left"], base, strict=False)])
        who = np.concatenate([np.frombuffer(x, "<i8") for x in rows["docs"]])
        at = np.concatenate([np.frombuffer(x, "<i4") for x in rows["at"]])
        n = base[-1]
        lcp, size, order = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        for i, (s, shared_, p) in enumerate(merge(streams)):
            lcp[i], size[i], order[i] = shared_, len(s), p
        left_lcp, left_size, rank = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        for r, (s, shared_, p) in enumerate(merge(lefts)):
            left_lcp[r], left_size[places[p]], rank[places[p]] = shared_, len(s), r
        place = at[order].astype(np.int64)
        out = {"doc_id": who[order]}
        for lo, hi, wide in (("lo", "hi", length), ("rlo", "rhi", report)):
            least, most_ = resolve(lcp, size, rank[order], left_lcp, left_size[order], wide)
            out |= {lo: np.where(least >= 0, place - most_, -1), hi: np.where(least >= 0, place - least + wide, -1)}
        return pd.DataFrame(out)[lambda x: (x["lo"] >= 0) | (x["rlo"] >= 0)]

    shape = "doc_id long, lo long, hi long, rlo long, rhi long"
    sent = sub.dropDuplicates(["doc_id"]).join(asked, "doc_id").select("doc_id", "text", "q").mapInArrow(runs, "target int, " + ", ".join(f"{c} binary" for c in names[1:]))
    edges = sent.groupBy("target").applyInPandas(merged, shape)
    spans = whole.union(edges)
    if not crowd.isEmpty():
        spans = spans.union(_counted(sub, classes.join(crowd, "h", "left_semi"), length, report))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids_, removed, runs_, digests, again = [], [], [], [], []
            for doc, text, *lists_ in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), *(batch.column(c).to_pylist() for c in ("los", "his", "rlos", "rhis")), strict=True):
                lo, hi, rlo, rhi = (np.array(x, dtype=np.int64) for x in lists_)
                starts, ends = _runs(lo, hi, len(text), length)
                r_starts, r_ends = _runs(rlo, rhi, len(text), report)
                digest = hashlib.sha256()
                for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(text)], strict=True):
                    digest.update(text[a:b])
                ids_.append(doc)
                removed.append(int((ends - starts).sum()))
                runs_.append(len(starts))
                digests.append(digest.hexdigest())
                again.append(int((r_ends - r_starts).sum()))
            yield pa.RecordBatch.from_arrays([pa.array(ids_, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs_, pa.int64()), pa.array(digests, pa.string()), pa.array(again, pa.int64())], names=["doc_id", "removed", "runs", "sha", "again"])

    own = spans.groupBy("doc_id").agg(*[F.collect_list(c).alias(f"{c}s") for c in ("lo", "hi", "rlo", "rhi")])
    cut = scratch.keep(sub.dropDuplicates(["doc_id"]).join(own, "doc_id").select("doc_id", "text", "los", "his", "rlos", "rhis").mapInArrow(cut_out, "doc_id long, removed long, runs long, sha string, again long"), "cut")
    plain = rows.select("doc_id", "id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("all_sha"))
    none = F.lit(0).cast("long")
    return plain.join(cut, "doc_id", "left").select(
        F.col("id").alias("doc_id"), "n_bytes", F.coalesce("removed", none).alias("n_removed"), F.coalesce("runs", none).alias("n_spans"), F.coalesce("sha", "all_sha").alias("kept_sha256"), F.coalesce("again", none).alias("n_repeated")
    )


def _counted(texts: DataFrame, classes: DataFrame, length: int, report: int) -> DataFrame:
    """Spans at anchors of too many kinds of surroundings: all their strings' hashes, counted by Spark."""
    asked = classes.groupBy("doc_id").agg(F.collect_list("at").alias("at"))

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, places in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("at").to_pylist(), strict=True):
                data = np.frombuffer(text, dtype=np.uint8)
                hashes = Hashes(data)
                for at in places:
                    for wide in (length, report):
                        start = np.arange(max(0, at - (wide - GRAM)), min(at, len(data) - wide) + 1)
                        s = hashes.of(start, start + wide).astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), doc)), pa.array(start, pa.int64()), pa.array(s), pa.array(np.full(len(s), wide, dtype=np.int32))], names=["doc_id", "lo", "s", "wide"])

    made = texts.dropDuplicates(["doc_id"]).join(asked, "doc_id").select("doc_id", "text", "at").mapInArrow(strings, "doc_id long, lo long, s long, wide int").distinct()  # anchors near each other share strings
    twice = made.groupBy("s", "wide").agg(F.count("*").alias("n")).filter("n > 1").select("s", "wide")
    none = F.lit(-1).cast("long")
    side = lambda wide, at: F.when(F.col("wide") == wide, at).otherwise(none)
    hit = made.join(twice, ["s", "wide"], "left_semi")
    if length == report:
        return hit.select("doc_id", "lo", (F.col("lo") + length).alias("hi"), F.col("lo").alias("rlo"), (F.col("lo") + length).alias("rhi"))
    return hit.select("doc_id", side(length, F.col("lo")).alias("lo"), side(length, F.col("lo") + length).alias("hi"), side(report, F.col("lo")).alias("rlo"), side(report, F.col("lo") + report).alias("rhi"))
