"""Chunks of transcripts, panels and notes, their headers, and what must be embedded anew.

Budgets are bytes of UTF-8. The transcript chunker is a fold over a document's utterances, so it is the one
operator that sees a document's rows together (one document's, sorted by Spark).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.functions.batches import small_batches
from quillspan.functions.text import paragraphs, sections, strip_footer

CHUNK = T.StructType([T.StructField(n, T.StringType()) for n in ("source_type", "source_id", "document_id", "text", "metadata_json")])


@dataclass(frozen=True)
class Config:
    """Fixed ratios of the model's length: 68 % target, 20 % overlap, four characters a token."""

    max_tokens: int = 512
    target_tokens: int = 348
    overlap_tokens: int = 102
    min_chars: int = 50
    mode: str = "chars"  # or "utterances"

    def __post_init__(self):
        if not 0 < self.target_tokens <= self.max_tokens or not 0 <= self.overlap_tokens < self.target_tokens or self.mode not in ("chars", "utterances"):
            raise ValueError(f"not a chunking configuration: {self}")

    @classmethod
    def of_model(cls, max_tokens: int, **stored) -> Config:
        return cls(**({"max_tokens": max_tokens, "target_tokens": int(max_tokens * 0.68), "overlap_tokens": int(max_tokens * 0.20)} | {k: v for k, v in stored.items() if v is not None}))

    target = property(lambda self: self.target_tokens * 4)
    cap = property(lambda self: self.max_tokens * 4)
    overlap = property(lambda self: self.overlap_tokens * 4)

    def notes(self) -> dict[str, str]:
        """What the index's metadata says of how it was cut."""
        return {"chunking_target_tokens": str(self.target_tokens), "chunking_overlap_tokens": str(self.overlap_tokens), "chunking_overlap_mode": self.mode}


def size(text: str) -> int:
    return len(text.encode())


def head(text: str, limit: int) -> str:
    """The longest beginning of at most ``limit`` bytes, one character at least."""
    return text.encode()[:limit].decode(errors="ignore") or text[:1]


def tail(text: str, limit: int) -> str:
    """The longest end of at most ``limit`` bytes; it may start within a character's reach, never inside one."""
    return text.encode()[max(0, size(text) - limit) :].decode(errors="ignore") if limit > 0 else ""


def cut(text: str, limit: int) -> tuple[str, str]:
    """(what fits, the rest): after the last sentence that fits, else before its last space, else anywhere."""
    if size(text) <= limit:
        return text, ""
    fits = head(text, max(1, limit))
    stop = max(fits.rfind(c) for c in ".!?") + 1
    if stop == 0 and (space := fits.rfind(" ")) > 0:
        stop = space
    return (text[:stop], text[stop:].lstrip()) if stop else (fits, text[len(fits) :])


def cut_all(text: str, limit: int) -> list[str]:
    out, rest = [], text
    while True:
        fits, rest = cut(rest, limit)
        out.append(fits)
        if not rest:
            return out


@dataclass
class _Window:
    """The chunk that is being filled: carried-over lines first, then its own."""

    config: Config
    target: int
    cap: int
    carried: str = ""
    whole: list[str] = field(default_factory=list)  # the utterances that end it, for overlap by utterances
    own: list[str] = field(default_factory=list)
    first: int | None = None
    last: int | None = None
    start: object = None
    end: object = None

    @property
    def text(self) -> str:
        return "\n".join([*([self.carried] if self.carried else []), *self.own])

    def room(self) -> int:
        used = size(self.text)
        return self.cap - used - 1 if used else self.cap

    def with_(self, line: str) -> int:
        used = size(self.text)
        return size(line) + (used + 1 if used else 0)

    def add(self, line: str, i: int, start: object, end: object, complete: bool) -> None:
        self.own.append(line)
        self.whole = [*self.whole, line] if complete else []
        self.first = i if self.first is None else self.first
        self.last, self.end = i, end
        self.start = start if self.start is None else self.start

    def next(self) -> _Window:
        """An empty window that carries this one's end over."""
        fresh = _Window(self.config, self.target, self.cap)
        if self.config.mode == "chars":
            fresh.carried = tail(self.text, self.config.overlap)
        else:
            kept: list[str] = []
            for line in reversed(self.whole):
                if size("\n".join([line, *kept])) > self.config.overlap:
                    break
                kept.insert(0, line)
            fresh.carried, fresh.whole = "\n".join(kept), kept
        return fresh

    def shrink(self, allowed: int) -> None:
        """What is carried over gives way to what is new."""
        if size(self.carried) <= allowed:
            return
        if self.config.mode == "chars":
            self.carried = tail(self.carried, allowed)
        else:
            while self.whole and size("\n".join(self.whole)) > allowed:
                self.whole = self.whole[1:]
            self.carried = "\n".join(self.whole)


def transcript_windows(rows: list[dict], config: Config, header_bytes: int = 0) -> Iterator[tuple[str, int, int, object, object]]:
    """(text, first, last, start, end) of windows over utterances (text, source, start, end) in order.

    No window is without a line of its own, none exceeds the cap, and short ones are left out.
    """
    labels = {"microphone": "[You] ", "system": "[Other] "}
    w = _Window(config, max(0, config.target - header_bytes), max(0, config.cap - header_bytes))

    def done(w: _Window):
        if size(w.text) >= config.min_chars:
            yield w.text, w.first, w.last, w.start, w.end

    for i, row in enumerate(rows):
        said = row["text"] or ""
        if not said.strip():
            continue
        line, complete = labels.get(row["source"], "") + said, True
        if w.own and w.with_(line) > w.cap:
            yield from done(w)
            w = w.next()
        while size(line) > w.cap:
            fits, line = cut(line, max(w.room(), 0))
            w.add(fits, i, row["start"], row["end"], False)
            yield from done(w)
            w, complete = w.next(), True
        if not line:
            continue
        if w.own and w.with_(line) > w.target:
            yield from done(w)
            w = w.next()
        if not w.own and w.carried and w.with_(line) > w.cap:
            w.shrink(max(0, w.cap - size(line) - 1))
        w.add(line, i, row["start"], row["end"], complete)
    if w.own:
        yield from done(w)


def transcript_chunks(utterances: DataFrame, config: Config = Config(), headers: DataFrame | None = None) -> DataFrame:
    """Windows of every document, with the range of utterances and the speakers in it as metadata."""
    rows = utterances if headers is None else utterances.join(headers.select("document_id", "header"), "document_id", "left")
    rows = rows if "header" in rows.columns else rows.withColumn("header", F.lit(None).cast("string"))

    def windows(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start_timestamp", "seq"], kind="stable", na_position="first")
        own = [{"text": t, "source": s, "start": None if pd.isna(a) else a.isoformat(), "end": None if pd.isna(b) else b.isoformat(), "name": n} for t, s, a, b, n in zip(pdf["text"], pdf["source"], pdf["start_timestamp"], pdf["end_timestamp"], pdf["speaker_name"], strict=True)]
        header = pdf["header"].iloc[0] if len(pdf) else None
        out = []
        for n, (text, first, last, start, end) in enumerate(transcript_windows(own, config, size(header) if isinstance(header, str) else 0)):
            named = list(dict.fromkeys(r["name"] for r in own[first : last + 1] if (r["text"] or "").strip() and isinstance(r["name"], str)))
            meta = {"window_start_idx": first, "window_end_idx": last, "start_timestamp": start, "end_timestamp": end, "speakers": named}
            out.append(("transcript_window", f"{key[0]}:w{n}", key[0], text, json.dumps(meta)))
        return pd.DataFrame(out, columns=CHUNK.names)

    return rows.select("document_id", "seq", "text", "source", "start_timestamp", "end_timestamp", "speaker_name", "header").groupBy("document_id").applyInPandas(windows, CHUNK)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _parts(text: pd.Series, limit: pd.Series) -> pd.Series:
    return pd.Series([cut_all(t, int(n)) if isinstance(t, str) else [] for t, n in zip(text, limit, strict=True)])


def _split(units: DataFrame, prefix: Column, config: Config, kind: str, meta: Column) -> DataFrame:
    """Units (document_id, unit, header) cut to the cap; the first part keeps the plain id."""
    small_batches(units.sparkSession)
    limit = F.lit(config.cap) - F.coalesce(F.octet_length("header"), F.lit(0))
    rows = units.select("*", F.posexplode(_parts(F.col("unit"), limit)).alias("part", "piece")).filter(F.octet_length("piece") >= config.min_chars)
    suffix = F.when(F.col("part") > 0, F.concat(F.lit("p"), F.col("part"))).otherwise(F.lit(""))
    return rows.select(F.lit(kind).alias("source_type"), F.concat(prefix, suffix).alias("source_id"), "document_id", F.col("piece").alias("text"), F.to_json(meta).alias("metadata_json"))


def panel_chunks(panels: DataFrame, config: Config = Config(), headers: DataFrame | None = None) -> DataFrame:
    s = panels.filter("not deleted and content_markdown <> ''").select("id", "document_id", F.explode(sections(strip_footer(F.col("content_markdown")))).alias("s"))
    unit = F.concat_ws("\n\n", F.col("s.heading"), F.col("s.body"))
    rows = s.select("id", "document_id", F.col("s.idx").alias("idx"), F.col("s.heading").alias("heading"), unit.alias("unit")).filter(F.octet_length("unit") >= config.min_chars)
    meta = F.struct(F.col("id").alias("panel_id"), F.col("heading").alias("section_heading"), F.col("idx").alias("section_idx"))
    return _split(_headed(rows, headers), F.concat("id", F.lit(":s"), "idx"), config, "panel_section", meta)


def note_units(documents: DataFrame, min_chars: int, separator: str = "\n\n") -> DataFrame:
    """document_id, idx, unit: paragraphs of at least min_chars, numbered after shorter ones have gone."""
    live = documents.filter("deleted_at is null and notes_plain <> ''")
    long = F.filter(paragraphs(F.col("notes_plain"), separator), lambda p: F.octet_length(p) >= min_chars)
    return live.select(F.col("id").alias("document_id"), F.posexplode(long).alias("idx", "unit"))


def note_chunks(documents: DataFrame, config: Config = Config(min_chars=20), headers: DataFrame | None = None, separator: str = "\n\n") -> DataFrame:
    rows = note_units(documents, config.min_chars, separator)
    return _split(_headed(rows, headers), F.concat("document_id", F.lit(":n"), "idx"), config, "notes_paragraph", F.struct(F.col("idx").alias("paragraph_idx")))


def _headed(rows: DataFrame, headers: DataFrame | None) -> DataFrame:
    return rows.withColumn("header", F.lit(None).cast("string")) if headers is None else rows.join(headers.select("document_id", "header"), "document_id", "left")


#: The header's cap, and room in it for the two lines' framing.
HEADER_BYTES, FRAMING = 512, 28


def attendees(document_people: DataFrame) -> DataFrame:
    """document_id, names: distinct names, or else addresses, in order."""
    named = document_people.withColumn("name", F.coalesce("full_name", "email")).filter("name is not null")
    return named.groupBy("document_id").agg(F.array_sort(F.collect_set("name")).alias("names"))


def header_of(title: str | None, date: str | None, names: list[str]) -> str | None:
    """Meeting, date and as many attendees as the cap allows, then a blank line; None of nothing."""
    lines = [f"Meeting: {head(title, HEADER_BYTES - FRAMING) if size(title) > HEADER_BYTES - FRAMING else title}\n"] if title else []
    lines += [f"Date: {date}\n"] if date else []
    left = HEADER_BYTES - size("".join(lines)) - size("Attendees: ") - 2
    kept: list[str] = []
    for name in names:
        if size(", ".join([*kept, name])) > left:
            break
        kept.append(name)
    lines += [f"Attendees: {', '.join(kept)}\n"] if kept else []
    return "".join(lines) + "\n" if lines else None


def document_headers(documents: DataFrame, document_people: DataFrame) -> DataFrame:
    @F.pandas_udf("string")
    def made(title: pd.Series, date: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([header_of(t, d, list(n) if n is not None else []) for t, d, n in zip(title, date, names, strict=True)], dtype=object)

    rows = documents.filter("deleted_at is null").select(F.col("id").alias("document_id"), "title", F.date_format("created_at", "yyyy-MM-dd").alias("date")).join(attendees(document_people), "document_id", "left")
    return rows.select("document_id", made("title", "date", "names").alias("header")).filter("header is not null")


def content_hash(header: Column, text: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(header, F.lit("")), text), 256)


def desired(*parts: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """All chunks that should exist, with their hash."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return _headed(rows, headers).withColumn("content_hash", content_hash(F.col("header"), F.col("text")))


def diff(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """source_type, source_id and action: unchanged, refresh (metadata only), embed, or orphan.

    Metadata are compared as values, so the order of their keys doesn't matter.
    """
    key = ["source_type", "source_id"]
    parsed = lambda c: F.to_json(F.array_sort(F.map_entries(F.from_json(c, "map<string,string>"))))
    w = wanted.select(*key, F.col("content_hash").alias("wh"), parsed(F.col("metadata_json")).alias("wm"), F.lit(1).alias("w"))
    s = stored.select(*key, F.col("content_hash").alias("sh"), parsed(F.col("metadata_json")).alias("sm"), F.lit(1).alias("s"))
    action = F.when(F.col("w").isNull(), "orphan").when(F.col("s").isNull() | ~F.col("wh").eqNullSafe(F.col("sh")), "embed").when(~F.col("wm").eqNullSafe(F.col("sm")), "refresh").otherwise("unchanged")
    return w.join(s, key, "full_outer").select(*key, action.alias("action"))


def without_newest(chunks: DataFrame, n: int) -> DataFrame:
    """All chunks but the n latest."""
    newest = chunks.orderBy(F.col("created_at").desc(), F.col("source_type"), F.col("source_id")).limit(n).select("source_type", "source_id")
    return chunks.join(newest, ["source_type", "source_id"], "left_anti")
