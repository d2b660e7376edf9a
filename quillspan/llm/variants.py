"""Spelling variants: words one edit apart, found by merging the light subtrees of a trie of all words.

Words are sorted into ranges, and each range's task builds its part of the trie. At every node the child
with most words is heavy and stays where it is; each word below another child (a light one) is merged
once more with its character at the node skipped, replaced, or preceded by the heavy child's. Where two
terminals coincide, the words are one edit apart. A word passes at most log2(words) light edges, so it is
merged that often, whatever its length; no neighbourhood of all its edits is made.

* skip: a light word without the node's character is a word.
* insert: a light word with the heavy character put in before the node is a word.
* replace: a light word with the heavy character is a word, or two light words leave the same rest.

These find each pair once: a deletion inside a run of equal characters counts at the run's end only.
A node that lies inside one range is merged in its task. Nodes that ranges share (prefixes of the words at
their edges, so few) get their heavy child from a sum over ranges, and their light words are sent out
merged, to be joined with the words. Light words that leave the same rest differ in one character, so
such a group has at most one word a character.

Nulls and texts without words give nothing; a null doc_id counts as empty in the checksum; an empty table
gives no rows. Rows are texts: equal ones count as often as they are there, with their own doc_id. Texts
and words of any length are taken whole. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.scratch import Scratch

#: Fixed values of the contract.
SHORTEST, LEAST, TIMES, MARK = 7, 2, 10, 31
#: Entries that a task counts before it hands them on, words of a range and their code points.
HELD, RANGE_WORDS, RANGE_CHARS = 300_000, 100_000, 8_000_000

_RUN = re.compile(rb"[a-z\xc0-\xff]{%d,}" % SHORTEST)
_COUNTED = pa.schema([("word", pa.string()), ("n", pa.int64())])


def marked_words(doc_id: object, text: str) -> Counter:
    """The words of one text, as bytes of Latin-1 (which holds every letter that a run may have), and how often.

    Runs of other code points turn into question marks, one each, so runs stay maximal.
    """
    found: Counter = Counter()
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(_RUN.findall(text.encode("latin-1", "replace").lower())).items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % MARK == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < SHORTEST:
                continue
        found[run] += n
    return found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], schema=_COUNTED)

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if text.is_valid:
                held.update(marked_words(doc_id, text.as_py()))
                if len(held) > HELD:
                    yield out()
                    held = Counter()
    yield out()


def counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all words that occur often enough."""
    found = docs.select("doc_id", "text").mapInArrow(_counted, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)


def common(a: bytes, b: bytes) -> int:
    """How many first bytes are equal."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] == b[:low], a[:high] != b[:high]
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def neighbours_common(words: list[bytes], width: int = 32) -> list[int]:
    """For each of the sorted words how much it shares with the word before; -1 for the first and at the end."""
    if not words:
        return [-1]
    table = np.array(words, dtype=f"S{width}").view(np.uint8).reshape(len(words), width)
    differ = table[1:] != table[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    for i in np.flatnonzero(shared == width):
        shared[i] = common(words[i], words[i + 1])
    return [-1, *shared.tolist(), -1]


def branches(lcp: list[int]) -> Iterator[tuple[int, list[int], int]]:
    """(depth, first word of each child, end) of all branching nodes over sorted words; a terminal counts as a child."""
    stack: list[tuple[int, list[int]]] = []
    for i in range(1, len(lcp)):
        start, h = i - 1, lcp[i]
        while stack and stack[-1][0] > h:
            depth, starts = stack.pop()
            yield depth, starts, i
            start = starts[0]
        if h < 0:
            return
        if stack and stack[-1][0] == h:
            stack[-1][1].append(i)
        else:
            stack.append((h, [start, i]))


def _segments(words: list[bytes], depth: int, starts: list[int], end: int) -> list[tuple[int, int, bytes]]:
    """(first word, past the last, character) of each child; a terminal has no character."""
    return [(s, e, words[s][depth : depth + 1]) for s, e in zip(starts, [*starts[1:], end])]


def open_nodes(words: list[bytes], lcp: list[int], left: int, right: int) -> Iterator[tuple[str, int, list[tuple[int, int, bytes]]]]:
    """(side, depth, children) of the nodes that other ranges share: prefixes of the first word up to ``left``
    characters and of the last up to ``right`` (-1: there is no neighbour). A node that is both comes once."""
    n = len(words)
    whole = common(words[0], words[-1])
    for side, most in (("first", left), ("last", right)):
        edge = 0 if side == "first" else n - 1
        end, starts_at = n, 0
        inside = lcp[1:n]
        order = sorted(range(1, n), key=lambda i: inside[i - 1]) if most >= 0 else []
        at = 0
        for depth in range(most + 1):
            while at < len(order) and inside[order[at] - 1] < depth:  # words beyond such a place don't have the prefix
                if side == "first":
                    end = min(end, order[at])
                else:
                    starts_at = max(starts_at, order[at])
                at += 1
            if side == "last" and depth <= whole and depth <= left:
                continue
            if len(words[edge]) < depth:
                break
            here, k = [starts_at], at
            while k < len(order) and inside[order[k] - 1] == depth:
                if starts_at < order[k] < end:
                    here.append(order[k])
                k += 1
            yield side, depth, _segments(words, depth, here, end)


class _Near:
    """Near words of the words of one range: how many, and the one of largest n (ties: the smallest)."""

    def __init__(self, words: list[bytes], n: list[int]):
        self.words, self.n = words, n
        self.count = [0] * len(words)
        self.best = [-1] * len(words)
        self.place = {w: i for i, w in enumerate(words)}

    def put(self, i: int, j: int) -> None:
        b = self.best[i]
        if b < 0 or (-self.n[j], j) < (-self.n[b], b):
            self.best[i] = j

    def pair(self, i: int, other: bytes) -> None:
        j = self.place.get(other)
        if j is not None:
            self.count[i] += 1
            self.count[j] += 1
            self.put(i, j)
            self.put(j, i)

    def group(self, members: list[int]) -> None:
        ahead = sorted(members, key=lambda i: (-self.n[i], i))[:2]
        for i in members:
            self.count[i] += len(members) - 1
            self.put(i, ahead[0] if i != ahead[0] else ahead[1])


def merged(word: bytes, depth: int, heavy: bytes) -> tuple[list[bytes], bytes | None]:
    """The words that a light word may be one edit from at a node, and what it leaves when its character there is left open."""
    p, rest = word[:depth], word[depth:]
    found = [p + heavy + rest]
    if not rest:
        return found, None
    found.append(p + heavy + rest[1:])
    if rest[1:2] != rest[:1] and len(word) > SHORTEST:
        found.append(p + rest[1:])
    return found, p + b"*" + rest[1:]


def _ranked(sizes: list[tuple[int, int, bytes]]) -> bytes:
    """The heavy child's character."""
    return min((s - e, c) for s, e, c in sizes if c)[1]


def _inside(words: list[bytes], n: list[int], lcp: list[int], shared: set[tuple[str, int]]) -> _Near:
    """All pairs that meet at nodes of one range alone."""
    near = _Near(words, n)
    for depth, starts, end in branches(lcp):
        if (starts[0] == 0 and ("first", depth) in shared) or (end == len(words) and ("last", depth) in shared):
            continue
        children = _segments(words, depth, starts, end)
        heavy = _ranked(children)
        rests: dict[bytes, list[int]] = {}
        for s, e, c in children:
            if c == heavy:
                continue
            for i in range(s, e):
                others, left = merged(words[i], depth, heavy)
                for other in others:
                    near.pair(i, other)
                if left is not None:
                    rests.setdefault(left, []).append(i)
        for members in rests.values():
            if len(members) > 1:
                near.group(members)
    return near


def _range(table: pa.Table) -> tuple[list[bytes], list[int]]:
    rows = sorted(zip((w.encode("latin-1") for w in table.column("word").to_pylist()), table.column("n").to_pylist()))
    return [w for w, _ in rows], [n for _, n in rows]


def _edges(table: pa.Table, words: list[bytes]) -> tuple[int, int]:
    """How much a range's first word shares with the word before it, and its last with the word after; -1 without one."""
    before, after = table.column("before")[0].as_py(), table.column("after")[0].as_py()
    return (-1 if before is None else common(words[0], before.encode("latin-1")), -1 if after is None else common(words[-1], after.encode("latin-1")))


def _prefixes(words: list[bytes], left: int, right: int) -> dict[str, list[str]]:
    """Digests of the prefixes of the first and the last word, from the empty one on."""
    out = {}
    for side, word, most in (("first", words[0], left), ("last", words[-1], right)):
        running = hashlib.md5()
        out[side] = [running.hexdigest()]
        for at in range(most):
            running.update(word[at : at + 1])
            out[side].append(running.hexdigest())
    return out


def _shared_counts(key: tuple, table: pa.Table, edges: pa.Table) -> pa.Table:
    words, _ = _range(table)
    left, right = _edges(edges, words)
    digests = _prefixes(words, left, right)
    rows = [(key[0].as_py(), side, depth, digests[side][depth], c.decode("latin-1"), e - s) for side, depth, children in open_nodes(words, neighbours_common(words), left, right) for s, e, c in children]
    return pa.Table.from_pylist([dict(zip(_SHARED.names, r)) for r in rows], schema=_SHARED)


_SHARED = pa.schema([("shard", pa.int32()), ("side", pa.string()), ("depth", pa.int32()), ("prefix", pa.string()), ("c", pa.string()), ("n", pa.int64())])
_FOUND = pa.schema([("kind", pa.string()), ("key", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _merge(key: tuple, table: pa.Table, heavies: pa.Table) -> pa.Table:
    """What a range finds alone (kind near), and its light words at shared nodes, merged (word, rest)."""
    words, n = _range(table)
    lcp = neighbours_common(words)
    shared = {(x["side"], x["depth"]): x["heavy"].encode("latin-1") for x in heavies.to_pylist() if x["side"] is not None}
    near = _inside(words, n, lcp, set(shared))
    text = [w.decode("latin-1") for w in words]
    columns: list[list] = [[], [], [], [], [], [], []]

    def put(*values: object) -> None:
        for column, value in zip(columns, values):
            column.append(value)

    for i, count in enumerate(near.count):
        if count:
            put("near", None, text[i], n[i], count, n[near.best[i]], text[near.best[i]])
    most = {side: max((d for s, d in shared if s == side), default=-1) for side in ("first", "last")}
    for side, depth, children in open_nodes(words, lcp, most["first"], most["last"]) if words else ():
        heavy = shared[side, depth]
        for s, e, c in children:
            if c == heavy:
                continue
            for i in range(s, e):
                others, left = merged(words[i], depth, heavy)
                for other in others:
                    put("word", other.decode("latin-1"), text[i], n[i], None, None, None)
                if left is not None:
                    put("rest", left.decode("latin-1"), text[i], n[i], None, None, None)
    return pa.table([pa.array(c, t.type) for c, t in zip(columns, _FOUND)], schema=_FOUND)


def ranges(scratch: Scratch, counted: DataFrame) -> DataFrame:
    """(shard, word, n): sorted ranges of bounded size."""
    size = counted.agg(F.count("*").alias("n"), F.sum(F.length("word")).alias("chars")).first()
    parts = 1 + max(size["n"] // RANGE_WORDS, (size["chars"] or 0) // RANGE_CHARS)
    dealt = counted.repartitionByRange(parts, "word")
    return scratch.keep(dealt.select(F.spark_partition_id().alias("shard"), "word", "n"), "ranges")


def near_counts(scratch: Scratch, words: DataFrame) -> DataFrame:
    """(word, n_near, best): for words with a near word how many there are, and (-n, word) of the most frequent."""
    order = Window.orderBy("shard")  # one row a range
    edges = words.groupBy("shard").agg(F.min("word").alias("low"), F.max("word").alias("high"))
    edges = scratch.keep(edges.select("shard", F.lag("high").over(order).alias("before"), F.lead("low").over(order).alias("after")), "edges")
    shared = scratch.keep(words.groupBy("shard").cogroup(edges.groupBy("shard")).applyInArrow(_shared_counts, "shard int, side string, depth int, prefix string, c string, n long"), "shared")
    summed = shared.groupBy("depth", "prefix", "c").agg(F.sum("n").alias("n")).filter("c <> ''")
    heavy = summed.groupBy("depth", "prefix").agg(F.min(F.struct(-F.col("n"), "c")).alias("h")).select("depth", "prefix", F.col("h.c").alias("heavy"))
    heavies = shared.select("shard", "side", "depth", "prefix").distinct().join(heavy, ["depth", "prefix"]).select("shard", "side", "depth", "heavy")
    heavies = heavies.unionByName(words.select("shard").distinct().selectExpr("shard", "cast(null as string) side", "cast(null as int) depth", "cast(null as string) heavy"))
    found = words.groupBy("shard").cogroup(heavies.groupBy("shard")).applyInArrow(_merge, "kind string, key string, word string, n long, n_near long, best_n long, best string")
    found = scratch.keep(found, "merged")
    other = F.struct((-F.col("n")).alias("n"), F.col("word").alias("word"))
    alone = found.filter("kind = 'near'").select("word", "n_near", F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")).alias("best"))
    met = found.filter("kind = 'word'").select("key", other.alias("a")).join(words.select(F.col("word").alias("key"), F.struct((-F.col("n")).alias("n"), F.col("word").alias("word")).alias("b")), "key")
    pairs = met.select(F.explode(F.array(F.struct(F.col("a.word").alias("word"), F.col("b").alias("best")), F.struct(F.col("b.word").alias("word"), F.col("a").alias("best")))).alias("p"))
    pairs = pairs.select("p.word", F.lit(1).cast("long").alias("n_near"), "p.best")
    rests = found.filter("kind = 'rest'").groupBy("key").agg(F.sort_array(F.collect_list(other)).alias("all")).filter(F.size("all") > 1)
    rests = rests.select(F.explode("all").alias("x"), (F.size("all") - 1).cast("long").alias("n_near"), F.slice("all", 1, 2).alias("two"))
    rests = rests.select("x.word", "n_near", F.when(F.col("x") == F.col("two")[0], F.col("two")[1]).otherwise(F.col("two")[0]).alias("best"))
    return alone.unionByName(pairs).unionByName(rests).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def _roots(scratch: Scratch, forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form. Each round doubles the steps taken; n grows tenfold a step, so rounds are few."""
    roots = forms.select("word", F.col("form").alias("root"))
    while True:
        up = roots.select(F.col("word").alias("root"), F.col("root").alias("up"))
        fresh = scratch.keep(roots.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "roots")
        if fresh.filter("moved").isEmpty():
            return fresh.select("word", "root")
        roots = fresh.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """One row a word: word, form (its near word of largest n, if ten times as frequent), root (the last of its forms),
    n, n_near, form_n."""
    scratch = Scratch(docs.sparkSession, "variants")
    words = ranges(scratch, scratch.keep(counts(docs), "counts"))
    near = near_counts(scratch, words)
    is_form = -F.col("best.n") >= F.col("n") * TIMES
    all_words = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.n")).alias("form_n"))
    all_words = scratch.keep(all_words, "forms")
    roots = _roots(scratch, all_words.filter("form is not null"))
    return all_words.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
