"""Stored tables in ranges of their key's hash: a change rewrites the ranges that it touches, and no other.

A table is a manifest (see ``Commits``) that names one folder for each of 2**bits equal ranges of a 64-bit hash.
An upsert classifies incoming rows once, against the keys (and guards) of their own ranges; only ranges with an inserted
or updated row are written, into a new folder, and a commit names them. Ranges that stay keep their files, so readers
of older commits go on and a commit is as large as what changed.

A commit fails if another writer's was first. If that one changed other ranges, ours is made on top of it; else the
change is made anew on the new head, a few times, then ``Conflict`` is raised.

Each commit lists the keys that it changed: ``changes`` is the feed between two commits. Hashes spread any keys evenly,
so no range is hot but for rows of one key.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspan.operators import ingest
from quillspan.sources.commits import Commits, Conflict

RANGE_ROWS = 1_000_000  # of a table that is written whole


class RangeTable:
    def __init__(self, spark: SparkSession, root: str, schema: str, key: str = "id", by: str | None = None):
        """key: what tells rows apart; by: what ranges are of, where that is another column (a parent's key)."""
        self.spark, self.root, self.schema, self.key, self.by = spark, root.rstrip("/"), schema, key, by or key
        self.commits = Commits(spark, root)

    # ---- reading

    def version(self) -> int:
        return self.commits.head()[0]

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema)

    def _files(self, manifest: dict, ranges: Iterable[int] | None = None) -> DataFrame:
        named = manifest.get("ranges", {})
        paths = [f"{self.root}/{p}" for r, p in named.items() if ranges is None or int(r) in set(ranges)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self._empty()

    def read(self, at: int | None = None) -> DataFrame:
        """The table as of a commit (the last by default); later columns are null where files are older than they."""
        return self._files(self.commits.head()[1] if at is None else self.commits.read(at) if at >= 0 else {})

    def range_of(self, by: Column, bits: int) -> Column:
        return F.shiftrightunsigned(F.xxhash64(by.cast("string")), 64 - bits).cast("int") if bits else F.lit(0)

    def changes(self, since: int) -> DataFrame:
        """key, action (inserted, updated, removed or replaced) of what the commits after ``since`` changed; a key may be there more than once."""
        paths = [f"{self.root}/{p}" for n in self.commits.numbers() if n > since and (p := self.commits.read(n).get("changes"))]
        return self.spark.read.schema("key string, action string").parquet(*paths) if paths else self.spark.createDataFrame([], "key string, action string")

    # ---- writing

    def _shaped(self, df: DataFrame) -> DataFrame:
        fields = StructType.fromDDL(self.schema)
        return df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])

    def _write(self, rows: DataFrame, bits: int, folder: str) -> dict[str, str]:
        """Write rows by range into a new folder; the ranges that have any."""
        ranged = self._shaped(rows).withColumn("range_", self.range_of(F.col(f"`{self.by}`"), bits))
        ranged.repartition("range_").write.partitionBy("range_").parquet(f"{self.root}/{folder}")
        p, fs = self.commits._fs(f"{self.root}/{folder}")
        names = [f.getPath().getName() for f in fs.listStatus(p)]
        return {n.split("=")[1]: f"{folder}/{n}" for n in names if n.startswith("range_=")}

    def replace(self, df: DataFrame, bits: int | None = None) -> int:
        """Make ``df`` the table. bits: of the number of ranges; by the number of rows where not given."""
        n, head = self.commits.head()
        folder = f"v{n + 1:06d}-{uuid.uuid4().hex[:8]}"
        if bits is None:
            bits = max(head.get("bits", 0), (df.count() // RANGE_ROWS).bit_length())
        ranges = self._write(df, bits, f"{folder}/rows")
        self.commits.commit(n + 1, {"bits": bits, "ranges": ranges, "folder": folder})
        return n + 1

    def _changed(self, make: Callable[[dict], tuple[dict[int, int] | None, DataFrame | None, DataFrame, dict]], attempts: int, note: dict | None = None) -> dict:
        """Commit a change. make(head): the ranges to write (None for none), their new rows, the changed keys, and what to return."""
        for _ in range(attempts):
            n, head = self.commits.head()
            folder = f"v{n + 1:06d}-{uuid.uuid4().hex[:8]}"
            touched, rows, keys, out = make(head)
            if not touched:
                return out
            bits = head.get("bits", 0)
            written = self._write(rows, bits, f"{folder}/rows")
            keys.write.parquet(f"{self.root}/{folder}/changes")
            own = {str(r): written.get(str(r)) for r in touched}
            while True:
                now, latest = self.commits.head()
                before, after = head.get("ranges", {}), latest.get("ranges", {})
                if latest.get("bits", 0) != bits or any(before.get(r) != after.get(r) for r in own):
                    break  # another writer changed these ranges: make the change anew
                ranges = {r: p for r, p in {**after, **own}.items() if p}
                try:
                    self.commits.commit(now + 1, {"bits": bits, "ranges": ranges, "changes": f"{folder}/changes", "folder": folder, **(note or {})})
                    return out
                except Conflict:
                    continue
        raise Conflict(f"{self.root}: other writers kept changing the same ranges")

    def _first(self, rows: int) -> None:
        """The empty table's first commit, with as many ranges as its first rows need."""
        if self.version() < 0:
            try:
                self.commits.commit(0, {"bits": (rows // RANGE_ROWS).bit_length(), "ranges": {}})
            except Conflict:
                pass

    def upsert(self, incoming: DataFrame, guard: str | None = None, insert_only: tuple[str, ...] = ("source_account_id",), attempts: int = 3, note: dict | None = None) -> dict[str, int]:
        """Insert and update rows by key (see ``ingest.upsert``); how many were inserted, updated and unchanged. ``note`` goes into the commit.

        Incoming rows are reduced to one a key and written once; counts, changed ranges and new rows come from that.
        """
        aside = f"{self.root}/incoming-{uuid.uuid4().hex[:8]}"
        ingest.latest(incoming, self.key, guard).write.parquet(aside)
        fresh = self.spark.read.schema(incoming.schema).parquet(aside)
        self._first(fresh.count())

        def make(head: dict):
            bits = head.get("bits", 0)
            ranged = fresh.withColumn("range_", self.range_of(F.col(f"`{self.by}`"), bits))
            near = self._files(head, [r["range_"] for r in ranged.select("range_").distinct().collect()])  # at most all ranges' numbers
            columns = [self.key] if guard is None else [self.key, guard]
            joined = ranged.alias("n").join(near.select(*columns, F.lit(True).alias("have")).alias("o"), F.col(f"n.{self.key}") == F.col(f"o.{self.key}"), "left")
            same = F.lit(False) if guard is None else F.col(f"o.{guard}").eqNullSafe(F.col(f"n.{guard}"))
            action = F.when(F.col("have").isNull(), "inserted").when(same, "unchanged").otherwise("updated")
            actions = joined.select(F.col(f"n.{self.key}").cast("string").alias("key"), "range_", action.alias("action"))
            per = actions.groupBy("range_").pivot("action", ["inserted", "updated", "unchanged"]).count().na.fill(0).collect()
            counts = {a: sum(r[a] for r in per) for a in ("inserted", "updated", "unchanged")}
            touched = {r["range_"]: r["inserted"] + r["updated"] for r in per if r["inserted"] + r["updated"]}
            mine = ranged.filter(F.col("range_").isin(list(touched))).drop("range_")
            rows = ingest.upsert(self._files(head, touched), mine, self.key, guard, insert_only, reduced=True)
            return touched, rows, actions.filter("action <> 'unchanged'").select("key", "action"), counts

        try:
            return self._changed(make, attempts, note)
        finally:
            self.commits.delete(aside)

    def replace_children(self, fresh: DataFrame, parents: DataFrame, attempts: int = 3) -> dict[str, int]:
        """Rows of ``parents`` (a column named as ``by``) are replaced by the fresh ones; rows of others stay."""
        own = parents.select(F.col(self.by).cast("string").alias(self.by)).distinct()
        self._first(0)

        def make(head: dict):
            touched = [r[0] for r in own.select(self.range_of(F.col(self.by), head.get("bits", 0))).distinct().collect()]
            rows = ingest.replace_children(self._files(head, touched), self._shaped(fresh), own, self.by)
            return dict.fromkeys(touched, 1), rows, own.select(F.col(self.by).alias("key"), F.lit("replaced").alias("action")), {"ranges": len(touched)}

        return self._changed(make, attempts)

    def remove(self, keys: DataFrame, attempts: int = 3) -> dict[str, int]:
        """Take out rows whose ``by`` is among ``keys`` (a column of that name)."""
        gone = keys.select(F.col(self.by).cast("string").alias(self.by)).distinct()

        def make(head: dict):
            asked = [r[0] for r in gone.select(self.range_of(F.col(self.by), head.get("bits", 0))).distinct().collect()]
            near = self._files(head, asked)
            hit = near.join(gone, self.by, "left_semi")
            per = {r["r"]: r["n"] for r in hit.groupBy(self.range_of(F.col(self.by), head.get("bits", 0)).alias("r")).agg(F.count("*").alias("n")).collect()}
            rows = self._files(head, per).join(gone, self.by, "left_anti")
            return per, rows, hit.select(F.col(self.by).cast("string").alias("key"), F.lit("removed").alias("action")).distinct(), {"removed": sum(per.values())}

        return self._changed(make, attempts)

    def restore(self, at: int) -> int:
        """Make an older commit's rows the table again; its files must still be there."""
        n, old = self.version(), self.commits.read(at) if at >= 0 else {"bits": 0, "ranges": {}}
        self.commits.commit(n + 1, {"bits": old["bits"], "ranges": old["ranges"], "folder": f"restored-{at}"})
        return n + 1

    def regroup(self, bits: int) -> int:
        """The same rows in another number of ranges."""
        return self.replace(self.read(), bits)

    def drop_before(self, n: int) -> None:
        """Delete folders that no commit from n on names, and the older commits."""
        numbers = self.commits.numbers()
        kept = [self.commits.read(x) for x in numbers if x >= n]
        used = {p.split("/")[0] for c in kept for p in [*c.get("ranges", {}).values(), *([c["changes"]] if c.get("changes") else [])]}
        for x in numbers:
            if x < n:
                folder = self.commits.read(x).get("folder")
                if folder and folder not in used:
                    self.commits.delete(f"{self.root}/{folder}")
        # a folder of an older commit may hold ranges that are still named: it goes with the last of them
        older = {self.commits.read(x).get("folder") for x in numbers if x < n} & used
        for x in numbers:
            if x < n and self.commits.read(x).get("folder") not in older:
                self.commits.delete(f"{self.commits.folder}/{x:012d}.json")
