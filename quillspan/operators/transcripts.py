"""Transcripts: loading, speakers, gaps and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.text import contains

MOST_NAMES = 10_000  # that a pattern may stand for

def load(utterances: DataFrame, document_id: str) -> DataFrame:
    return utterances.filter(F.col("document_id") == document_id).orderBy("start_timestamp", "id")


def by_speaker(utterances: DataFrame, speaker: str, names: list[str] | None = None) -> DataFrame:
    """``me`` is the microphone, ``other`` the system; else the resolved names, without regard to case."""
    if speaker.lower() == "me":
        return utterances.filter("source = 'microphone'")
    if speaker.lower() == "other":
        return utterances.filter("source = 'system'")
    return utterances.filter(F.lower("speaker_name").isin([n.lower() for n in (names if names is not None else [speaker])]))


def speakers(utterances: DataFrame) -> DataFrame:
    return utterances.filter("trim(speaker_name) <> ''").select("speaker_name").distinct().orderBy("speaker_name")


def resolve_names(utterances: DataFrame, pattern: str) -> list[str]:
    """Names that a pattern stands for: an equal one alone, else all that hold it. None is an error that lists some."""
    if not pattern.strip():
        raise ValueError("a speaker's name is needed")
    known = speakers(utterances)
    exact = F.lower("speaker_name") == pattern.strip().lower()
    equal = known.filter(exact).collect()  # spellings of one name that differ in case
    if equal:
        return sorted(r[0] for r in equal)
    found = known.filter(contains(F.col("speaker_name"), pattern.strip())).limit(MOST_NAMES + 1).collect()
    if len(found) > MOST_NAMES:
        raise ValueError(f"{pattern!r} stands for more than {MOST_NAMES} speakers")
    if not found:
        some = [r[0] for r in known.limit(10).collect()]
        raise ValueError(f"no speaker {pattern!r}; known: {', '.join(some)}")
    return sorted(r[0] for r in found)


def show_speaker(utterances: DataFrame, document_id: str, speaker: str, names: list[str] | None = None) -> tuple[DataFrame, str]:
    """That speaker's utterances of a document, and ``ok``, ``no transcript`` or ``not in transcript``."""
    own = load(utterances, document_id)
    theirs = by_speaker(own, speaker, names)
    state = own.agg(F.count("*").alias("n")).first()["n"], theirs.agg(F.count("*").alias("n")).first()["n"]
    return theirs, "no transcript" if not state[0] else "ok" if state[1] else "not in transcript"


def numbered(utterances: DataFrame) -> DataFrame:
    """idx: 0-based place in the document."""
    w = Window.partitionBy("document_id").orderBy("start_timestamp", "seq")
    return utterances.withColumn("idx", F.row_number().over(w) - 1)


def runs_and_gaps(utterances: DataFrame) -> DataFrame:
    """document_id, source, run, n, first_seq, seconds, gap: unbroken runs of one channel, and the pause before."""
    w = Window.partitionBy("document_id").orderBy("start_timestamp", "seq")
    change = F.when(F.coalesce("source", F.lit("")) != F.coalesce(F.lag("source").over(w), F.lit("?")), 1).otherwise(0)
    marked = utterances.withColumn("change", change).withColumn("pause", F.unix_timestamp("start_timestamp") - F.unix_timestamp(F.lag("end_timestamp").over(w)))
    named = marked.withColumn("run", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return named.groupBy("document_id", "source", "run").agg(
        F.count("*").alias("n"), F.min("seq").alias("first_seq"), (F.max(F.unix_timestamp("end_timestamp")) - F.min(F.unix_timestamp("start_timestamp"))).alias("seconds"), F.max(F.when(F.col("change") == 1, F.col("pause"))).alias("gap")
    )
