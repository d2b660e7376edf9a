"""Results as JSON rows, envelopes, a ledger and directories; rendering is of one page only."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.text import speaker_label
from quillspan.operators.ingest import transfer_decision
from quillspan.sources.replication import file_hashes, listed


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON object a row; nulls are left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def envelope(page: DataFrame, total: DataFrame, query: str, limit: int, total_name: str = "total_meetings") -> DataFrame:
    """One row: query, the total, limit, returned and the page's meetings in order (pos)."""
    columns = [c for c in page.columns if c != "pos"]
    rows = page.agg(F.count("*").alias("returned"), F.transform(F.array_sort(F.collect_list(F.struct("pos", F.struct(*columns).alias("m")))), lambda x: x["m"]).alias("meetings"))
    return total.toDF(total_name).crossJoin(rows).select(F.lit(query).alias("query"), total_name, F.lit(limit).alias("limit"), "returned", "meetings")


def match_json(matches: DataFrame) -> DataFrame:
    """A match as shown: the speaker as me, other or nothing; empty lists are nulls, so that they are left out."""
    speaker = F.when(F.col("speaker") == "microphone", "me").when(F.col("speaker") == "system", "other")
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    return matches.withColumns({"speaker": speaker, "before": some("before"), "after": some("after")})


def page(rows: DataFrame, limit: int) -> DataFrame:
    """The first rows; 0 is all."""
    return rows.limit(limit) if limit else rows


def dump_candidates(ranked: DataFrame, path: str) -> None:
    """One JSON line for each query with its candidates in order."""
    rows = ranked.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "document_id", "score"))), lambda x: F.struct(x["document_id"].alias("document_id"), x["score"].alias("score"))).alias("candidates"))
    rows.write.mode("overwrite").json(path)


def record_run(metrics: DataFrame, ledger: str, runs: str, name: str) -> str:
    """Append to the ledger and write the run under a name that no other run has; returns the path."""
    spark = metrics.sparkSession
    path, n = f"{runs}/{name}", 1
    fs_of = spark._jvm.org.apache.hadoop.fs
    while True:
        p = fs_of.Path(path)
        if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            break
        n += 1
        path = f"{runs}/{name}-{n}"
    metrics.write.json(path)
    metrics.withColumn("run", F.lit(path)).write.mode("append").json(ledger)
    return path


def copy_tables(spark: SparkSession, names: list[str], source: str, target: str, hashes: dict[str, tuple[str, str | None, str | None]], force: bool = False) -> dict[str, str]:
    """Replicate stored tables where ``ingest.transfer_decision`` lets them go (or ``force``); returns what it said of each.

    hashes: each table's content hash at the source, at the target (null: none there) and at the last copy.
    """
    rows = spark.createDataFrame([(n, *hashes[n]) for n in names], "name string, source string, target string, synced string")
    said = {r["name"]: r["d"] for r in rows.select("name", transfer_decision(F.col("source"), F.col("target"), F.col("synced")).alias("d")).collect()}  # a row a table
    for name in [n for n in names if said[n] == "proceed" or force]:
        spark.read.parquet(f"{source}/{name}").write.mode("overwrite").parquet(f"{target}/{name}")
    return said


def content_hashes(spark: SparkSession, path: str, block: int = 4 << 20) -> DataFrame:
    """path and hash of files: SHA-256 over the SHA-256 of each block, which tasks read one by one."""
    return file_hashes(listed(spark, [path]), block).select("path", "hash")


def utterance_rows(utterances: DataFrame, tz: str = "UTC") -> DataFrame:
    """Time of day, speaker and text of a transcript, as shown."""
    local = F.from_utc_timestamp("start_timestamp", tz)
    return utterances.select(F.date_format(local, "HH:mm:ss").alias("time"), speaker_label(F.col("source"), F.col("speaker_name")).alias("speaker"), "text")


def short_date(at: datetime) -> str:
    return f"{at:%b} {at.day}, {at.year}"


def card(rank: int, row: dict) -> str:
    """A result as lines of text: rank, id, date and title, then its matches and what more there is."""
    lines = [f"{rank}. [{row['id'][:8]}] {short_date(row['created_at'])}  {row['title'] or '(untitled)'}"]
    for m in row.get("matches") or []:
        where = " ".join(x for x in (m["source"], m["section"] or "", m["speaker_name"] or "") if x)
        lines.append(f"   {where}: {m['excerpt']['text']}")
    more = row["total_matches"] - len(row.get("matches") or [])
    if more > 0:
        places = list(row.get("remaining") or [])
        joined = ", ".join(places[:-1]) + (" and " if places[:-1] else "") + places[-1] if places else ""
        lines.append(f"   +{more} more matches in {joined}")
    return "\n".join(lines)
