"""A stored positional index of a source's rows: immutable segments, tombstones, exact statistics, and top k with skipping.

A batch of rows (document_id, row_id, text and perhaps live) writes one segment and nothing else. A segment has

* ``postings``: term, range, row_id, document_id, live, len, tf, positions; made where the rows are, in runs of about
  ``RUN_TOKENS`` words sorted by term and range, so a query reads its terms' pages only, and positions only for phrases.
  A range's first posting of a term also has how many there are (n), and the greatest share of a score that one has (most);
* ``rows``: row_id, its bucket, len and words: what a later batch needs to take an old version of a row out again;
* ``terms``: how the number of rows with a term changes, old versions that went included;
* ``gone``: (segment, row_id) of old versions of its rows, and of rows removed.

Rows and tokens are summed in the commit (see ``Commits``), so scores never need a scan of the corpus and are those of
``search.bm25`` over the present rows. ``merge`` makes one segment of several and drops what is gone.

Batches hold a row_id once (the last by a digest, if twice). A null text counts as a row without words. Rows without a
row_id are left out.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions.text import phrases, tokens
from quillspan.operators.search import K1, B, LEAST_IDF
from quillspan.sources.commits import Commits

#: At most 2**RANGE_BITS rows of a run are a range; at most so many ranges are named in a filter, beyond they are joined.
RANGE_BITS, NAMED = 10, 5000
#: Words that a task sorts at once; bytes of text of a task, and of a bucket of the first batch, and the most buckets.
RUN_TOKENS, TASK_BYTES, BUCKET_BYTES, MOST_BUCKETS = 1_000_000, 16 << 20, 128 << 20, 4096
POSTINGS = "term string, range long, row_id string, document_id string, live boolean, len int, tf int, positions array<int>, n long, most double"
ROWS = "row_id string, document_id string, live boolean, w array<string>, len int, part int"
TERMS = "term string, df long, bucket int"
GONE = "segment string, row_id string"


def impact(tf: Column, length: Column, average: float) -> Column:
    """A term's share of a row's score, without its weight; it grows with tf and falls with the length."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(average)))


class TextIndex:
    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        """buckets: folders of a segment's postings; fixed by the first batch, by its tokens where not given."""
        self.spark, self.root, self.commits = spark, root.rstrip("/"), Commits(spark, root)
        self.buckets = self.commits.head()[1].get("buckets") or buckets or 0

    # ---- reading

    def _head(self) -> tuple[int, dict]:
        n, head = self.commits.head()
        return n, head or {"segments": [], "rows": 0, "tokens": 0, "buckets": self.buckets}

    def _table(self, what: str, schema: str, head: dict) -> DataFrame:
        """A part of all segments, with the segment's name. Files are listed by the manifest, not by their folder."""
        parts = [self.spark.read.schema(schema).parquet(f"{self.root}/{s['name']}/{what}").withColumn("segment", F.lit(s["name"])) for s in head["segments"]]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema + ("" if "segment" in schema else ", segment string"))

    def _gone(self, head: dict) -> DataFrame:
        parts = [self.spark.read.schema(GONE).parquet(f"{self.root}/{s['name']}/gone") for s in head["segments"] if s["gone"]]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], GONE)

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.crc32(term), F.lit(max(1, self.buckets))).cast("int")

    def _of_terms(self, df: DataFrame, terms: list[str]) -> DataFrame:
        """Rows of these terms; both filters reach the scan."""
        return df.filter(F.col("bucket").isin(sorted({zlib.crc32(t.encode()) % max(1, self.buckets) for t in terms})) & F.col("term").isin(terms))

    def postings(self, terms: list[str] | None = None, head: dict | None = None) -> DataFrame:
        """Postings of present rows."""
        head = head or self._head()[1]
        df = self._table("postings", POSTINGS, head)
        df = df if terms is None else df.filter(F.col("term").isin(terms))
        return df.join(self._gone(head), ["segment", "row_id"], "left_anti") if any(s["gone"] for s in head["segments"]) else df

    def statistics(self) -> dict[str, int]:
        head = self._head()[1]
        return {"rows": head["rows"], "tokens": head["tokens"], "segments": len(head["segments"])}

    def seen(self) -> int:
        """The last batch that a commit names; -1 before the first."""
        return self._head()[1].get("batch", -1)

    def frequencies(self, terms: list[str] | None = None) -> DataFrame:
        """term, df over present rows, read from the small table of each segment."""
        df = self._table("terms", TERMS, self._head()[1])
        df = df if terms is None else self._of_terms(df, terms)
        return df.groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")

    # ---- writing

    def _part(self, row_id: Column) -> Column:
        return F.pmod(F.crc32(row_id), F.lit(max(1, self.buckets))).cast("int")

    def append(self, rows: DataFrame, removed: DataFrame | None = None, batch: int | None = None) -> int:
        """Index new versions of rows, and take out those of ``removed`` (row_id, or document_id for all its rows). Returns the commit's number.

        batch: a stream's batch number, kept in the commit; one that is there already is not indexed again.
        """
        n, head = self._head()
        if batch is not None and batch <= head.get("batch", -1):
            return n
        return self._append(n, head, rows, removed, batch)

    def _append(self, n: int, head: dict, rows: DataFrame, removed: DataFrame | None, batch: int | None) -> int:
        name = f"s{n + 1:06d}-{uuid.uuid4().hex[:8]}"
        live = F.coalesce(F.col("live"), F.lit(False)) if "live" in rows.columns else F.lit(True)
        plain = rows.filter("row_id is not null").select(F.col("row_id").cast("string").alias("row_id"), F.col("document_id").cast("string").alias("document_id"), live.alias("live"), "text")
        size = plain.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        self.buckets = self.buckets or min(MOST_BUCKETS, 1 + size // BUCKET_BYTES)
        # texts are cut into words by enough tasks: small files and coalesced shuffles would leave few
        tasks = max(self.spark.sparkContext.defaultParallelism, 1 + size // TASK_BYTES)
        tasks = -(-tasks // self.buckets) * self.buckets  # so a task's rows are of few buckets
        dealt = plain.withColumn("slot", F.pmod(F.crc32("row_id"), F.lit(tasks))).withColumn("part", F.pmod("slot", F.lit(self.buckets)).cast("int")).withColumn("digest", F.xxhash64("document_id", "live", "text")).repartition(tasks, "slot")
        last = F.row_number().over(Window.partitionBy("part", "slot", "row_id").orderBy(F.col("digest").desc()))
        fresh = dealt.withColumn("k", last).filter("k = 1").select("row_id", "document_id", "live", tokens(F.col("text")).alias("w"), "part")
        average = self._write(name, fresh)
        mine = self.spark.read.schema(ROWS).parquet(f"{self.root}/{name}/rows")
        old, gone, minus, path = self._superseded(head, mine.select("row_id", "part"), removed)
        if gone:
            old.select("segment", "row_id").write.parquet(f"{self.root}/{name}/gone")
        self._write_terms(name, old if gone else None)
        size = mine.agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("t")).first()
        entry = {"name": name, "rows": size["n"], "gone": bool(gone), "average": average}
        self.commits.commit(n + 1, {"segments": [*head["segments"], entry], "rows": head["rows"] + size["n"] - gone, "tokens": head["tokens"] + size["t"] - minus, "buckets": self.buckets, "batch": head.get("batch", -1) if batch is None else batch})
        if path:
            self.commits.delete(path)
        return n + 1

    def _superseded(self, head: dict, keys: DataFrame, removed: DataFrame | None) -> tuple[DataFrame | None, int, int, str | None]:
        """Present versions of rows that a batch replaces or removes (written), how many, their tokens, and where they are.

        Only the folders of the batch's keys are read; their names are at most as many as there are buckets.
        """
        if not head["segments"]:
            return None, 0, 0, None
        by_document = removed is not None and "document_id" in removed.columns
        if removed is not None and not by_document:
            out = removed.filter("row_id is not null").select(F.col("row_id").cast("string").alias("row_id"))
            keys = keys.unionByName(out.withColumn("part", self._part(F.col("row_id")))).distinct()
        stored = self._table("rows", ROWS, head)
        if not by_document:
            stored = stored.filter(F.col("part").isin([r[0] for r in keys.select("part").distinct().collect()]))
        present = stored.join(self._gone(head), ["segment", "row_id"], "left_anti") if any(s["gone"] for s in head["segments"]) else stored
        path = f"{self.root}/superseded-{uuid.uuid4().hex}"
        kept = ["segment", "row_id", "len", F.array_distinct("w").alias("terms")]
        hit = present.join(keys.select("row_id"), "row_id", "left_semi").select(*kept)
        if by_document:
            own = removed.select(F.col("document_id").cast("string").alias("document_id")).distinct()
            hit = hit.unionByName(present.join(own, "document_id", "left_semi").select(*kept)).dropDuplicates(["segment", "row_id"])
        hit.write.parquet(path)
        old = self.spark.read.parquet(path)
        size = old.agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("t")).first()
        return old, size["n"], size["t"], path

    def _write(self, name: str, fresh: DataFrame) -> float:
        """rows and postings of one segment; the average length that the shares in its postings are for.

        fresh: row_id, document_id, live, w, part, in order of part. Texts are cut into words once, and a row's postings are made
        and sorted where the row is: nothing is shuffled.
        """
        path = f"{self.root}/{name}"
        fresh.withColumn("len", F.size("w")).write.partitionBy("part").parquet(f"{path}/rows")
        rows = self.spark.read.schema(ROWS).parquet(f"{path}/rows")
        size = rows.agg(F.count("*").alias("n"), F.sum("len").alias("t")).first()
        average = max(1, size["t"] or 0) / max(1, size["n"])
        posted = rows.select("row_id", "document_id", "live", "len", "w").mapInArrow(_posted(average, RANGE_BITS, RUN_TOKENS), POSTINGS)
        posted.write.option("parquet.block.size", 8 << 20).parquet(f"{path}/postings")
        return average

    def _write_terms(self, name: str, old: DataFrame | None) -> None:
        path = f"{self.root}/{name}"
        terms = self.spark.read.schema(POSTINGS).parquet(f"{path}/postings").filter("n is not null").groupBy("term").agg(F.sum("n").alias("df"))
        if old is not None:
            minus = old.select(F.explode("terms").alias("term")).groupBy("term").agg((-F.count("*")).alias("df"))
            terms = terms.unionByName(minus).groupBy("term").agg(F.sum("df").alias("df"))
        out = terms.withColumn("bucket", self._bucket(F.col("term")))
        out.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/terms")

    def merge(self) -> int:
        """One segment of all, without what is gone; old segments stay until ``drop_unused``."""
        n, head = self._head()
        name = f"s{n + 1:06d}-{uuid.uuid4().hex[:8]}"
        rows = self._table("rows", ROWS, head)
        if any(s["gone"] for s in head["segments"]):
            rows = rows.join(self._gone(head), ["segment", "row_id"], "left_anti")
        average = self._write(name, rows.select("row_id", "document_id", "live", "w", "part"))
        self._write_terms(name, None)
        self.commits.commit(n + 1, {**head, "segments": [{"name": name, "rows": head["rows"], "gone": False, "average": average}]})
        return n + 1

    def rebuild(self, rows: DataFrame, batch: int | None = None) -> int:
        """The index anew from its source."""
        n, head = self._head()
        return self._append(n, {**head, "segments": [], "rows": 0, "tokens": 0}, rows, None, batch)

    def drop_unused(self) -> None:
        """Delete segments that the head doesn't name; no reader of an older commit must be at work."""
        used = {s["name"] for s in self._head()[1]["segments"]}
        p, fs = self.commits._fs(self.root)
        for f in fs.listStatus(p):
            folder = f.getPath().getName()
            if folder != "log" and folder not in used:
                fs.delete(f.getPath(), True)

    def drift(self, rows: DataFrame) -> DataFrame:
        """kind, n: postings that only the index has (stale), or only the source (missing)."""
        words = rows.select(F.col("row_id").cast("string").alias("row_id"), F.explode(tokens(F.col("text"))).alias("term"))
        fresh = words.groupBy("row_id", "term").agg(F.count("*").cast("int").alias("tf"))
        mine = self.postings().select("row_id", "term", "tf")
        stale = mine.exceptAll(fresh).select(F.lit("stale").alias("kind"))
        return stale.unionAll(fresh.exceptAll(mine).select(F.lit("missing").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))

    # ---- ranking

    def _counted(self, parts: list[list[str]], postings: DataFrame) -> DataFrame:
        """segment, row_id, document_id, live, len and f0, f1, ... (how often each part stands in the row) of rows with any term."""
        terms = sorted({w for p in parts for w in p})
        keys = ["segment", "row_id", "document_id", "live", "len"]
        if len(terms) == 1 and len(parts) == 1 and len(parts[0]) == 1:
            return postings.select(*keys, F.col("tf").alias("f0"))
        phrased = any(len(p) > 1 for p in parts)
        held = F.col("positions") if phrased else F.lit(None).cast("array<int>")
        rows = postings.select(*keys, "term", "tf", held.alias("p")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("term", F.struct("tf", "p")))).alias("of"))  # a row's terms of the query

        def count(part: list[str]) -> Column:
            found = [F.col("of")[w] for w in part]
            if len(part) == 1:
                return F.coalesce(found[0]["tf"], F.lit(0))
            follows = lambda at: reduce(Column.__and__, [F.array_contains(x["p"], at + k) for k, x in enumerate(found) if k])
            return F.coalesce(F.size(F.filter(found[0]["p"], follows)), F.lit(0)) * F.when(reduce(Column.__and__, [x.isNotNull() for x in found]), 1).otherwise(0)

        return rows.select(*keys, *[count(p).cast("int").alias(f"f{i}") for i, p in enumerate(parts)])

    def _weight(self, rows: int, df: Column) -> Column:
        idf = F.log((F.lit(rows) - df + 0.5) / (df + 0.5))
        return F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)

    def bm25(self, query: str) -> DataFrame:
        """document_id and score (lower is better) of each live row with every part of the query, as ``search.bm25``."""
        parts, head = phrases(query), self._head()[1]
        if not parts or not head["rows"]:
            return self.spark.createDataFrame([], "document_id string, score double")
        counted = self._counted(parts, self.postings(sorted({w for p in parts for w in p}), head))
        tf = [f"f{i}" for i in range(len(parts))]
        dfs = counted.agg(*[F.count_if(F.col(c) > 0).alias(f"n_{c}") for c in tf])
        hits = counted.filter("live").filter(reduce(Column.__and__, [F.col(c) > 0 for c in tf])).crossJoin(F.broadcast(dfs))  # one row
        average = head["tokens"] / head["rows"]
        score = reduce(lambda s, c: s - self._weight(head["rows"], F.col(f"n_{c}")) * impact(F.col(c), F.col("len"), average), tf, F.lit(0.0))
        return hits.select("document_id", score.alias("score"))

    def top(self, query: str, k: int, allowed: DataFrame | None = None) -> tuple[DataFrame, dict[str, int]]:
        """(document_id, score) of all documents that score as well as the k-th best, and what was read for it.

        allowed: (id) of the documents that count. Bounds of ranges of rows come from their first postings; the best ranges are scored
        first, and then only those ranges whose bound reaches the k-th score. Exact: what is skipped can't reach it.
        Queries with phrases are ranked whole, as their weights need all positions.
        """
        parts, head = phrases(query), self._head()[1]
        terms = sorted({p[0] for p in parts if len(p) == 1})
        if not parts or not head["rows"] or any(len(p) > 1 for p in parts):
            best = self._documents(self.bm25(query), allowed)
            worst = best.orderBy("score").limit(k).agg(F.max("score")).first()[0]
            return best.filter(F.col("score") <= F.lit(worst)), {"ranges": 0, "ranges_read": 0, "postings": 0, "postings_read": 0}
        times = {t: sum(p == [t] for p in parts) for t in terms}
        average = head["tokens"] / head["rows"]
        df = {r["term"]: r["df"] for r in self.frequencies(terms).collect()}
        if len(df) < len(terms):
            return self.spark.createDataFrame([], "document_id string, score double"), {"ranges": 0, "ranges_read": 0, "postings": 0, "postings_read": 0}
        idf = {t: math.log((head["rows"] - df[t] + 0.5) / (df[t] + 0.5)) for t in terms}
        weight = {t: times[t] * (w if w > 0 else LEAST_IDF) for t, w in idf.items()}
        weights = F.create_map(*[F.lit(x) for t in terms for x in (t, weight[t])])
        blocks = self._table("postings", POSTINGS, head).filter(F.col("term").isin(terms)).filter("n is not null")
        # a longer average raises a share by its own growth at most, a shorter one lowers it
        grown = F.create_map(*[F.lit(x) for s in head["segments"] for x in (s["name"], max(1.0, average / s["average"]))])
        bound = blocks.groupBy("segment", "range").agg(F.count("*").alias("have"), F.sum("n").alias("n"), F.sum(weights[F.col("term")] * F.col("most") * grown[F.col("segment")]).alias("bound"))
        # sums in another order may differ in their last digits
        bound = bound.withColumn("bound", F.when(F.col("have") == len(terms), F.col("bound") * (1 + 1e-9) + 1e-12)).cache()
        try:
            all_ranges = bound.agg(F.count("*").alias("ranges"), F.sum("n").alias("postings")).first()
            whole = bound.filter("bound is not null")
            first = whole.orderBy(F.col("bound").desc(), "segment", "range").limit(2 + (4 * k >> RANGE_BITS))
            seen = self._scored(terms, weights, head, average, first, allowed)
            kth = seen.orderBy("score").limit(k).agg(F.count("*").alias("n"), F.max("score").alias("s")).first()
            least = -kth["s"] if kth["n"] == k else -1.0
            chosen = whole.filter(F.col("bound") >= F.lit(least))
            read = chosen.agg(F.count("*").alias("ranges"), F.coalesce(F.sum("n"), F.lit(0)).alias("postings")).first()
            best = self._scored(terms, weights, head, average, chosen, allowed)
            worst = best.orderBy("score").limit(k).agg(F.max("score")).first()[0]
            out = best.filter(F.col("score") <= F.lit(worst))
        finally:
            bound.unpersist()
        return out, {"ranges": all_ranges["ranges"], "ranges_read": read["ranges"], "postings": all_ranges["postings"] or 0, "postings_read": read["postings"]}

    def _scored(self, terms: list[str], weights: Column, head: dict, average: float, ranges: DataFrame, allowed: DataFrame | None) -> DataFrame:
        """Best row of each document among some ranges."""
        postings = self.postings(terms, head)
        named = ranges.select("segment", "range").limit(NAMED + 1).collect()
        if len(named) <= NAMED:
            by: dict[str, list[int]] = {}
            for r in named:
                by.setdefault(r["segment"], []).append(r["range"])
            places = [(F.col("segment") == s) & F.col("range").isin(x) for s, x in by.items()]
            postings = postings.filter(reduce(Column.__or__, places) if places else F.lit(False))
        else:
            postings = postings.join(ranges.select("segment", "range"), ["segment", "range"], "left_semi")
        share = weights[F.col("term")] * impact(F.col("tf"), F.col("len"), average)
        if len(terms) == 1:
            rows = postings.filter("live").select("document_id", (-share).alias("score"))
        else:
            rows = postings.filter("live").groupBy("segment", "row_id", "document_id").agg(F.count("*").alias("have"), F.sum(-share).alias("score")).filter(F.col("have") == len(terms)).select("document_id", "score")
        return self._documents(rows, allowed)

    def _documents(self, rows: DataFrame, allowed: DataFrame | None) -> DataFrame:
        best = rows.groupBy("document_id").agg(F.min(F.round("score", 12)).alias("score"))  # so sums of equal shares tie
        return best if allowed is None else best.join(allowed.select(F.col("id").alias("document_id")), "document_id", "left_semi")


def search_top(documents: DataFrame, indexes: dict[str, TextIndex], query: str, k: int, allowed: DataFrame) -> DataFrame:
    """id, title, created_at, score of the first k documents over all sources: best score, then newest, then id.

    allowed: (id) of documents that count. Each source gives all that can be among its first k.
    """
    best = reduce(DataFrame.unionByName, [x.top(query, k, allowed)[0] for x in indexes.values()]).groupBy("document_id").agg(F.min("score").alias("score"))
    found = documents.join(best, documents["id"] == best["document_id"]).select("id", "title", "created_at", "score")
    return found.orderBy(F.col("score").asc(), F.col("created_at").desc(), F.col("id").asc()).limit(k)


def _posted(average: float, range_bits: int, run_tokens: int):
    """Makes a posting for each row and distinct word, with the word's places in the row, in runs sorted by term and range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_range = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            ends = np.cumsum(batch.column("len").to_numpy())
            lo = 0
            while lo < batch.num_rows:
                before = ends[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, before + run_tokens - size, side="right")))
                held.append(batch.slice(lo, hi - lo))
                size += int(ends[hi - 1] - before)
                lo = hi
                if size >= run_tokens or lo < batch.num_rows:
                    yield from _inverted(held, average, range_bits, next_range)
                    next_range += 1 + (sum(b.num_rows for b in held) >> range_bits)
                    held, size = [], 0
        if held:
            yield from _inverted(held, average, range_bits, next_range)

    return run


def _inverted(held: list[pa.RecordBatch], average: float, range_bits: int, first_range: int) -> Iterator[pa.RecordBatch]:
    names = ["term", "range", "row_id", "document_id", "live", "len", "tf", "positions", "n", "most"]
    rows = pa.Table.from_batches(held).combine_chunks()
    lengths = rows.column("len").to_numpy().astype(np.int64)
    words = pa.chunked_array([b.column("w").flatten() for b in held]).combine_chunks()
    if not len(words):
        return
    coded = (words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words).dictionary_encode()
    by_term = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(by_term), dtype=np.int64)
    rank[by_term] = np.arange(len(by_term))
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = (np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
    key = rank[coded.indices.to_numpy(zero_copy_only=False)] * len(lengths) + row
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.flatnonzero(np.concatenate([[True], np.diff(key) != 0]))
    term, of = np.divmod(key[new], len(lengths))
    tf = np.diff(np.append(new, len(key)))
    group = np.flatnonzero(np.concatenate([[True], (np.diff(term) != 0) | (np.diff(of >> range_bits) != 0)]))
    share = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[of] / average))
    n, most, first = np.zeros(len(new), dtype=np.int64), np.zeros(len(new)), np.ones(len(new), dtype=bool)
    n[group], most[group], first[group] = np.diff(np.append(group, len(new))), np.maximum.reduceat(share, group), False
    place = place[order]
    for lo in range(0, len(new), 50_000):
        hi = min(len(new), lo + 50_000)
        starts = np.append(new[lo:hi], new[hi] if hi < len(new) else len(key))
        at = pa.array(of[lo:hi])
        given = rows.select(["row_id", "document_id", "live", "len"]).take(at).combine_chunks()
        positions = pa.ListArray.from_arrays(pa.array((starts - starts[0]).astype(np.int32)), pa.array(place[starts[0] : starts[-1]]))
        whole = [pa.array(n[lo:hi], mask=first[lo:hi]), pa.array(most[lo:hi], mask=first[lo:hi])]
        columns = [coded.dictionary.take(pa.array(by_term[term[lo:hi]])), pa.array(first_range + (of[lo:hi] >> range_bits)), *(c.combine_chunks() for c in given.columns), pa.array(tf[lo:hi].astype(np.int32)), positions, *whole]
        yield from pa.table(columns, names=names).to_batches()
