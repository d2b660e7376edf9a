"""Phrase collocations: minimal perfect hashing of candidate phrases, counted in arrays by slot.

1. Candidates, one scan of the texts a length (1 to 4 words): tasks count hashes of phrases whose two parts
   without the last and without the first word both passed the length before (their hashes are in a bitmap of
   fixed size), Spark sums them, and those of the least frequency stay. Hash collisions and chance hits in the
   bitmap only add candidates, so none is missed (Apriori).
2. A scan gathers the candidates' texts, each from one place (the least of the texts' hashes that hold it). They are dealt into blocks of bounded size by hash, and each block's task
   builds its minimal perfect hash by displacement: buckets, larger ones first, get a number that sends their keys
   to free slots, buckets of one key get the slot itself. Each slot stores its key, 95 bits of two hash families.
3. A last scan counts. Tasks hand the candidates' counts to their blocks, at most so many tasks to one array, where
   each key's slot is looked up, the stored key is compared, and a bincount adds up. The arrays are summed as a tree.
4. A phrase's cuts read their parts' counts by slot in the parts' blocks. Scores are whole numbers, decimals where
   products may pass 64 bits.

Nothing of a size that follows the corpus is broadcast or sent to the driver: the bitmaps have 16 MiB at most, one
a length. What tasks hold is bounded: a run of texts, so many hashes, or a block's keys.

Null texts are empty, a null lang counts as ``und``. Texts of any length are taken whole; repeated rows count as
often as they are there. Ties of score and frequency go by the phrase's bytes. An empty table gives no rows.
Columns other than text and lang are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from quillspan.llm.scratch import Scratch
from quillspan.llm.tokens import Hashes, U, _spans, mix, pieces

#: Fixed values of the contract.
LONGEST, LEAST, TOP = 4, 30, 2000
#: Hashes that a task holds, keys of a block, tasks of one array, groups that a block's readers are dealt over.
HELD, BLOCK, FAN, READERS = 1_000_000, 1 << 16, 64, 8
SECOND_BIT = 32  # where a hash's second bit of a bitmap is taken from

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?", *range(10, 14)]] = True
_INSIDE = ~_BREAK
_INSIDE[[32, 9]] = False
_WEIGHTS = mix(np.arange(101, 101 + LONGEST, dtype=np.uint64)) | U(1)
_PRIME, _ROOT, _STEP = (1 << 31) - 1, 1_103_515_245, 1_566_083_941
_prime_powers: list[np.ndarray] = []


def prime_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a root modulo the prime, and of its inverse."""
    if not _prime_powers or len(_prime_powers[0]) < n:
        size = max(1 << 16, 1 << n.bit_length())
        _prime_powers[:] = []
        for root in (_ROOT, pow(_ROOT, -1, _PRIME)):
            p = np.ones(1, dtype=np.int64)
            while len(p) < size:
                p = np.concatenate([p, p * pow(root, len(p), _PRIME) % _PRIME])
            _prime_powers.append(p)
    return _prime_powers[0], _prime_powers[1]


class Words:
    """The words of a run of texts, and hashes of phrases of them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lang: np.ndarray):
        self.data = _LOWER[data]
        self.starts, self.ends, first = _spans(_INSIDE[self.data], offsets)
        self.row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        broken = np.cumsum(_BREAK[self.data])[self.starts] if len(self.starts) else self.starts
        joined = (broken[1:] == broken[:-1]) & (self.row[1:] == self.row[:-1])
        self.whole = [np.ones(len(self.starts), dtype=bool)]  # by length: does a phrase begin here
        for k in range(1, LONGEST):
            here = np.zeros(len(self.starts), dtype=bool)
            if len(self.starts) > k:
                here[:-k] = self.whole[-1][:-k] & joined[k - 1 :]
            self.whole.append(here)
        hashes = Hashes(self.data)
        self.h = hashes.of(self.starts, self.ends)
        self.of_row = (hashes.of(offsets[:-1], offsets[1:]) >> U(44)).astype(np.int64)
        self.lang = lang[self.row] if len(lang) else np.zeros(0, dtype=np.uint64)
        self._second: np.ndarray | None = None

    def first(self, k: int, at: np.ndarray) -> np.ndarray:
        """64-bit hashes of the phrases of k words that begin at ``at``."""
        out = self.lang[at].copy()
        for j in range(k):
            out += self.h[at + j] * _WEIGHTS[j]
        return mix(out).view(np.int64)

    def second(self, k: int, at: np.ndarray) -> np.ndarray:
        """31-bit hashes of another family."""
        if self._second is None:
            up, down = prime_powers(len(self.data) + 1)
            sums = np.zeros(len(self.data) + 1, dtype=np.int64)
            np.cumsum((self.data.astype(np.int64) + 1) * up[: len(self.data)] % _PRIME, out=sums[1:])
            self._second = (sums[self.ends] - sums[self.starts]) % _PRIME * down[self.starts] % _PRIME
        out = (self.lang[at] % U(_PRIME)).astype(np.int64)
        for j in range(k):
            out = (out * _STEP + self._second[at + j] + 1) % _PRIME
        return out

    def place(self, at: np.ndarray) -> np.ndarray:
        """20 bits of the hash of the text that holds each place."""
        return self.of_row[self.row[at]]

    def text(self, k: int, at: int) -> str:
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[at : at + k], self.ends[at : at + k])).decode("utf-8", "replace")


class Bits:
    """A bitmap of hashes, two bits each: those put in always pass, others by chance. 16 bits a hash, 2**27 bits (16 MiB) at most."""

    def __init__(self, hashes: DataFrame, most: int = 1 << 27):
        self.bits = min(most, 1 << max(16, (16 * hashes.count()).bit_length()))
        both = F.explode(F.array("h", F.shiftright("h", SECOND_BIT)))
        at = hashes.select(both.alias("h")).select(F.pmod("h", F.lit(self.bits)).alias("q")).selectExpr("shiftright(q, 6) w", "shiftleft(1L, cast(q % 64 as int)) b")
        words = at.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
        self.words = np.zeros(self.bits // 64, dtype=np.uint64)
        if len(words):
            self.words[words["w"].to_numpy(dtype=np.int64)] = words["b"].to_numpy(dtype=np.int64).view(np.uint64)

    def _has(self, h: np.ndarray) -> np.ndarray:
        at = h & np.int64(self.bits - 1)
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & U(1) == 1

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = self._has(h)
        some = np.flatnonzero(out)
        out[some] = self._has(h[some] >> SECOND_BIT)
        return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, list[str]]]:
    """Words of runs of rows of (text, lang), and each row's lang."""
    known: dict[str, int] = {}
    for batch in batches:
        lang = batch.column(1).to_pylist()
        for x in set(lang) - known.keys():
            known[x] = int.from_bytes(hashlib.md5(x.encode()).digest()[:8], "little")
        keys = np.array([known[x] for x in lang], dtype=np.uint64)
        for lo, hi, data, offsets in pieces(batch.column(0)):
            yield Words(data, offsets, keys[lo:hi]), lang[lo:hi]


def candidates(words: Words, filters: list[Bits], longest: int = LONGEST) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length k up to ``longest``: k, where phrases of k words begin whose parts of k - 1 words both pass, and their hashes."""
    at = np.flatnonzero(words.whole[0])
    for k in range(1, longest + 1):
        if k > 1:
            ok = np.zeros(len(words.starts) + 1, dtype=bool)
            ok[at[filters[k - 2](h)]] = True
            at = at[words.whole[k - 1][at] & ok[at] & ok[at + 1]]
        h = words.first(k, at)
        yield k, at, h


def _added(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Distinct hashes, the sums of their counts and the least of their places."""
    h, n, place = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(h, kind="stable")
    h, n, place = h[order], n[order], place[order]
    new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[new], np.add.reduceat(n, new), np.minimum.reduceat(place, new)


def _placed(h: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A hash with a place, in one number."""
    return mix(h.view(np.uint64) ^ (place.astype(np.uint64) * U(0x9E3779B97F4A7C15))).view(np.int64)


def _count_hashes(k: int, filters: list) -> Callable:
    """Tasks' counts of hashes of phrases of k words; for single words by lang."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [f.value for f in filters]
        held: dict[str, list] = {}
        size = 0

        def out(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal size
            size = 0
            for lang in list(held):
                held[lang] = [_added(held[lang])]
                size += len(held[lang][0][0])
            if size > least:
                for lang, [found] in held.items():
                    for lo in range(0, len(found[0]), 1 << 16):
                        part = [pa.array(x[lo : lo + (1 << 16)]) for x in found]
                        yield pa.record_batch([pa.array([lang] * len(part[0]), pa.string()), *part], names=["lang", "h", "n", "place"])
                held.clear()
                size = 0

        for words, lang in _runs(batches):
            *_, (_, at, h) = candidates(words, own, k)
            place = words.place(at)
            if k == 1:
                names, of = np.unique(np.array(lang, dtype=object).astype(str), return_inverse=True)
                groups = [(str(x), of[words.row[at]] == i) for i, x in enumerate(names)]
            else:
                groups = [("", np.ones(len(at), dtype=bool))]
            for name, own_rows in groups:
                if own_rows.any():
                    held.setdefault(name, []).append(_added([(h[own_rows], np.ones(int(own_rows.sum()), dtype=np.int64), place[own_rows])]))
                    size += len(held[name][-1][0])
            if size > 2 * HELD:
                yield from out(HELD)
        yield from out(0)

    return run


def _gather(filters: list, wanted: list, placed: bool) -> Callable:
    """Texts and keys of the wanted candidates, and keys of the parts that their cuts leave, once a task (or a million).

    wanted: a bitmap a length, of hashes, or of hashes with the place that one text each is to be taken from.
    """
    schema = pa.schema([("lang", pa.string()), ("k", pa.int32()), ("phrase", pa.string()), ("h", pa.int64()), ("h2", pa.int64()), ("parts", pa.list_(pa.int64())), ("parts2", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, chosen = [f.value for f in filters], [f.value for f in wanted]
        seen: set[tuple[int, int]] = set()
        for words, lang in _runs(batches):
            for k, at, h in candidates(words, own):
                some = np.flatnonzero(own[k - 1](h))
                some = some[chosen[k - 1](_placed(h[some], words.place(at[some])) if placed else h[some])]
                at, h = at[some], h[some]
                h2 = words.second(k, at)
                one = _distinct(h, h2)
                one = [i for i, key in zip(one.tolist(), zip(h[one].tolist(), h2[one].tolist())) if key not in seen and not seen.add(key)]
                if not one:
                    continue
                at, h, h2 = at[one], h[one], h2[one]
                cuts = [(j, at) for j in range(1, k)]
                sides = [x for j, a in cuts for x in ((j, a), (k - j, a + j))]
                parts = np.stack([words.first(n, a) for n, a in sides], axis=1) if sides else np.zeros((len(at), 0), dtype=np.int64)
                parts2 = np.stack([words.second(n, a) for n, a in sides], axis=1) if sides else parts
                texts = [words.text(k, a) for a in at.tolist()]
                row = words.row[at]
                yield pa.record_batch([pa.array([lang[r] for r in row.tolist()], pa.string()), pa.array(np.full(len(at), k, dtype=np.int32)), pa.array(texts, pa.string()), pa.array(h), pa.array(h2), pa.array(parts.tolist(), pa.list_(pa.int64())), pa.array(parts2.tolist(), pa.list_(pa.int64()))], schema=schema)
            if len(seen) > HELD:
                seen.clear()

    return run


def _distinct(h: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Where each key is first."""
    order = np.lexsort((h2, h))
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    return order[new]


def perfect(h: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(displacements by bucket, slot of each key): a minimal perfect hash of distinct keys."""
    m = len(h)
    buckets = max(1, m // 3)
    key = mix(h.view(np.uint64) ^ mix(h2.astype(np.uint64)))
    bucket = ((key >> U(32)) % U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=buckets)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    seeds, slots, free = np.zeros(buckets, dtype=np.int32), np.zeros(m, dtype=np.int64), np.ones(m, dtype=bool)
    for b in np.argsort(-sizes, kind="stable"):
        if sizes[b] < 2:
            break
        members = order[begin[b] : begin[b + 1]]
        found, base, width = None, 1, 8
        while found is None:
            tried = np.arange(base, base + width, dtype=np.uint64)
            at = _displaced(key[members][:, None], tried[None, :], m)
            ok = free[at].all(axis=0)
            for i in np.flatnonzero(ok):
                if len(set(at[:, i].tolist())) == len(members):
                    found = i
                    break
            base, width = base + width, min(4096, width * 4)
        seeds[b] = tried[found]
        slots[members] = at[:, found]
        free[at[:, found]] = False
    single = np.flatnonzero(sizes == 1)
    left = np.flatnonzero(free)[: len(single)]
    seeds[single] = -left - 1
    slots[order[begin[single]]] = left
    return seeds, slots


def _displaced(key: np.ndarray, seed: np.ndarray, m: int) -> np.ndarray:
    return (mix(key + seed * U(0x9E3779B97F4A7C15)) % U(m)).astype(np.int64)


def slots_of(h: np.ndarray, h2: np.ndarray, seeds: np.ndarray, m: int) -> np.ndarray:
    """The slot of each key if it is one of the set, else any slot."""
    key = mix(h.view(np.uint64) ^ mix(h2.astype(np.uint64)))
    seed = seeds[((key >> U(32)) % U(len(seeds))).astype(np.int64)].astype(np.int64)
    return np.where(seed < 0, -seed - 1, _displaced(key, np.maximum(seed, 0).astype(np.uint64), m))


def _build(table: pa.Table) -> pa.Table:
    """A block's keys with their slots; the row of slot 0 holds the displacements."""
    h, h2 = table.column("h").to_numpy(), table.column("h2").to_numpy()
    seeds, slots = perfect(h, h2)
    held = pa.array([seeds.tobytes() if s == 0 else None for s in slots.tolist()], pa.binary())
    return table.append_column("slot", pa.array(slots)).append_column("seeds", held)


class _Block:
    """A block's minimal perfect hash with its stored keys."""

    def __init__(self, table: pa.Table):
        slot = table.column("slot").to_numpy()
        self.m = len(slot)
        self.h, self.h2 = np.empty(self.m, dtype=np.int64), np.empty(self.m, dtype=np.int64)
        self.h[slot], self.h2[slot] = table.column("h").to_numpy(), table.column("h2").to_numpy()
        self.seeds = np.frombuffer(next(x for x in table.column("seeds").to_pylist() if x is not None), dtype=np.int32)

    def find(self, h: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slot of each key, whether the stored key is this one)."""
        slot = slots_of(h, h2, self.seeds, self.m)
        return slot, (self.h[slot] == h) & (self.h2[slot] == h2)


def _send(filters: list, blocks: int) -> Callable:
    """Tasks' counts of candidates as packed rows (block, turn, keys, counts); so many tasks share a turn."""
    schema = pa.schema([("block", pa.int64()), ("turn", pa.int64()), ("h", pa.binary()), ("h2", pa.binary()), ("n", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [f.value for f in filters]
        turn = TaskContext.get().partitionId() // FAN
        held: list[np.ndarray] = []
        size = 0

        def summed() -> np.ndarray:
            x = np.concatenate(held, axis=1)
            order = np.lexsort((x[1], x[0]))
            x = x[:, order]
            new = np.flatnonzero(np.concatenate([[True], (x[0, 1:] != x[0, :-1]) | (x[1, 1:] != x[1, :-1])]))
            return np.stack([x[0, new], x[1, new], np.add.reduceat(x[2], new)])

        def out(x: np.ndarray) -> Iterator[pa.RecordBatch]:
            block = np.mod(x[0], blocks)
            order = np.argsort(block, kind="stable")
            x, block = x[:, order], block[order]
            cut = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(block)]):
                yield pa.record_batch([[int(block[lo])], [turn], [x[0, lo:hi].tobytes()], [x[1, lo:hi].astype(np.int32).tobytes()], [x[2, lo:hi].tobytes()]], schema=schema)

        for words, _ in _runs(batches):
            for k, at, h in candidates(words, own):
                ok = own[k - 1](h)
                if ok.any():
                    held.append(np.stack([h[ok], words.second(k, at[ok]), np.ones(int(ok.sum()), dtype=np.int64)]))
                    size += held[-1].shape[1]
            if size > 2 * HELD:
                held = [summed()]
                size = held[0].shape[1]
                if size > HELD:
                    yield from out(held[0])
                    held, size = [], 0
        if held:
            yield from out(summed())

    return run


def _bincount(key: tuple, sent: pa.Table, keys: pa.Table) -> pa.Table:
    """One array of counts by slot from the tasks of one turn."""
    if not keys.num_rows:
        return pa.table({"block": pa.array([], pa.int64()), "turn": pa.array([], pa.int64()), "counts": pa.array([], pa.binary())})
    block = _Block(keys)
    counts = np.zeros(block.m, dtype=np.int64)
    for h, h2, n in zip(*(sent.column(c).to_pylist() for c in ("h", "h2", "n"))):
        slot, ok = block.find(np.frombuffer(h, dtype=np.int64), np.frombuffer(h2, dtype=np.int32).astype(np.int64))
        counts += np.bincount(slot[ok], np.frombuffer(n, dtype=np.int64)[ok], block.m).astype(np.int64)  # a task's counts are far below 2**53
    return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "turn": pa.array([key[1].as_py()], pa.int64()), "counts": pa.array([counts.tobytes()], pa.binary())})


def _sum_arrays(key: tuple, table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), dtype=np.int64) for x in table.column("counts"))
    return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "turn": pa.array([key[1].as_py()], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})


def _by_slot(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), dtype=np.int64) for x in table.column("counts"))
    return pa.table({"block": pa.array(np.full(len(total), table.column("block")[0].as_py(), dtype=np.int64)), "slot": pa.array(np.arange(len(total), dtype=np.int64)), "n": pa.array(total)})


def _read(key: tuple, asked: pa.Table, keys: pa.Table) -> pa.Table:
    """The counts of the parts asked for, read by slot."""
    block = _Block(keys)
    counts = np.zeros(block.m, dtype=np.int64)
    counts[keys.column("slot").to_numpy()] = keys.column("n").to_numpy()
    slot, ok = block.find(asked.column("h").to_numpy(), asked.column("h2").to_numpy())
    n = np.where(ok, counts[slot], 0)
    return pa.table({"of_block": asked.column("of_block"), "of_slot": asked.column("of_slot"), "side": asked.column("side"), "n": pa.array(n)})


def _frequent(scratch: Scratch, docs: DataFrame) -> tuple[DataFrame, DataFrame, list]:
    """(lang, n) of all words; (k, h) of hashes that are frequent enough; a broadcast bitmap of them for each length."""
    spark = docs.sparkSession
    filters: list = []
    totals, hashes = None, None
    for k in range(1, LONGEST + 1):
        counted = docs.mapInArrow(_count_hashes(k, list(filters)), "lang string, h long, n long, place long").groupBy("lang", "h").agg(F.sum("n").alias("n"), F.min("place").alias("place"))
        if k == 1:
            counted = scratch.keep(counted, "words")
            totals = counted.groupBy("lang").agg(F.sum("n").alias("n"))
        kept = scratch.keep(counted.filter(F.col("n") >= LEAST).select(F.lit(k).alias("k"), "h", "n", "place"), f"frequent{k}")
        filters.append(spark.sparkContext.broadcast(Bits(kept)))
        hashes = kept if hashes is None else hashes.unionByName(kept)
    return totals, hashes, filters


def _wanted(spark: SparkSession, hashes: DataFrame) -> list:
    """A broadcast bitmap for each length of (k, h)."""
    return [spark.sparkContext.broadcast(Bits(hashes.filter(F.col("k") == k))) for k in range(1, LONGEST + 1)]


def _candidates(scratch: Scratch, docs: DataFrame, hashes: DataFrame, filters: list, wanted: list, placed: bool) -> DataFrame:
    gathered = docs.mapInArrow(_gather(filters, wanted, placed), "lang string, k int, phrase string, h long, h2 long, parts array<long>, parts2 array<long>").dropDuplicates(["lang", "phrase"])
    return scratch.keep(gathered.join(hashes, ["k", "h"], "left_semi"), "candidates")


@F.pandas_udf(LongType())
def _placed_column(h: pd.Series, place: pd.Series) -> pd.Series:
    return pd.Series(_placed(h.to_numpy(), place.to_numpy()))


def _all_counts(scratch: Scratch, docs: DataFrame, hashes: DataFrame, filters: list) -> tuple[DataFrame, int]:
    """``_counts`` of all candidates.

    A candidate's text is taken from the texts of one place. Were there several phrases of one hash, some might not be
    met there: then the exact counts fall short of the hash's, and these hashes' phrases are gathered everywhere.
    """
    at_places = hashes.select("k", _placed_column("h", "place").alias("h"))
    found = _candidates(scratch, docs, hashes, filters, _wanted(docs.sparkSession, at_places), True)
    counts, blocks = _counts(scratch, docs, found, filters)
    asked, met = hashes.groupBy("k", "h").agg(F.sum("n").alias("asked")), counts.groupBy("k", "h").agg(F.sum("n").alias("met"))
    missed = scratch.keep(asked.join(met, ["k", "h"], "left").filter("met is null or met < asked").select("k", "h"), "missed")
    if not missed.isEmpty():
        more = _candidates(scratch, docs, missed, filters, _wanted(docs.sparkSession, missed), False)
        counts, blocks = _counts(scratch, docs, scratch.keep(found.unionByName(more).dropDuplicates(["lang", "phrase"]), "candidates"), filters)
    return counts, blocks


def _counts(scratch: Scratch, docs: DataFrame, found: DataFrame, filters: list) -> tuple[DataFrame, int]:
    """Candidates with block, slot, seeds (at slot 0) and exact frequency n, and how many blocks there are."""
    blocks = 1 + found.count() // BLOCK
    keyed = found.withColumn("block", F.pmod(F.col("h"), F.lit(blocks)))
    plain = keyed.select("block", "h", "h2").groupBy("block").applyInArrow(_build, "block long, h long, h2 long, slot long, seeds binary")
    index = scratch.keep(plain, "index")
    sent = scratch.keep(docs.mapInArrow(_send(filters, blocks), "block long, turn long, h binary, h2 binary, n binary"), "sent")
    turns = index.join(sent.select("block", F.col("turn").alias("of_turn")).distinct(), "block")
    arrays = sent.groupBy("block", "turn").cogroup(turns.groupBy("block", "of_turn")).applyInArrow(_bincount, "block long, turn long, counts binary")
    most = sent.agg(F.max("turn")).first()[0] or 0
    while most >= FAN:  # a tree of sums: no group holds more than so many arrays
        most //= FAN
        arrays = arrays.withColumn("turn", F.floor(F.col("turn") / FAN)).groupBy("block", "turn").applyInArrow(_sum_arrays, "block long, turn long, counts binary")
    counts = arrays.groupBy("block").applyInArrow(_by_slot, "block long, slot long, n long")
    index = index.join(counts, ["block", "slot"])
    return scratch.keep(keyed.join(index, ["block", "h", "h2"]), "counts"), blocks


def collocations(docs: DataFrame) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each lang's first phrases by the score of their weakest cut."""
    scratch = Scratch(docs.sparkSession, "collocations")
    docs = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    totals, hashes, filters = _frequent(scratch, docs)
    counts, blocks = _all_counts(scratch, docs, hashes, filters)
    phrases = counts.filter((F.col("k") > 1) & (F.col("n") >= LEAST))
    longer = phrases.filter("k > 2").select("lang", "n", "k", F.split("phrase", " ").alias("w"))
    inner = longer.select("lang", "n", "k", "w", F.explode(F.expr("sequence(2, k - 1)")).alias("size")).select("lang", "n", "w", "size", F.explode(F.expr("sequence(1, k - size + 1)")).alias("at"))
    covered = inner.groupBy("lang", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("phrase")).agg(F.max("n").alias("inside"))
    kept = phrases.join(covered, ["lang", "phrase"], "left").filter(F.col("inside").isNull() | (F.expr("cast(inside as decimal(20,0)) * 100 < cast(n as decimal(20,0)) * 80")))
    kept = scratch.keep(kept.select("lang", "phrase", F.col("n").alias("a"), F.col("block").alias("of_block"), F.col("slot").alias("of_slot"), "parts", "parts2"), "kept")

    asked = kept.select("of_block", "of_slot", F.posexplode(F.arrays_zip("parts", "parts2")).alias("side", "p")).select("of_block", "of_slot", "side", F.col("p.parts").alias("h"), F.col("p.parts2").alias("h2"))
    asked = asked.select("*", F.pmod(F.col("h"), F.lit(blocks)).alias("block"), F.pmod(F.col("of_slot"), F.lit(READERS)).alias("reader"))
    keys = counts.select("block", "slot", "seeds", "h", "h2", "n").join(asked.select("block", F.col("reader").alias("of_reader")).distinct(), "block")
    read = asked.groupBy("block", "reader").cogroup(keys.groupBy("block", "of_reader")).applyInArrow(_read, "of_block long, of_slot long, side int, n long")
    cuts = read.groupBy("of_block", "of_slot", F.expr("side div 2 + 1").alias("cut")).agg(F.max(F.when(F.col("side") % 2 == 0, F.col("n"))).alias("l"), F.max(F.when(F.col("side") % 2 == 1, F.col("n"))).alias("r"))
    scored = cuts.join(kept.select("of_block", "of_slot", "a"), ["of_block", "of_slot"]).withColumn("score", F.expr("(cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    weakest = scored.groupBy("of_block", "of_slot").agg(F.min(F.struct("score", "cut", "l", "r")).alias("c"))
    best = kept.join(weakest, ["of_block", "of_slot"]).select("lang", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), F.col("c.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    top = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP)
    return top.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
