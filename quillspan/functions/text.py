"""Text functions as column expressions; Python only where a built-in can't say it."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lower-case letters of one mark over a Latin letter, and the plain letters they fold to; made from their decompositions.
MARKED, PLAIN = zip(*((chr(c), d[0]) for c in range(0xE0, 0x10000) if len(d := unicodedata.normalize("NFD", chr(c))) == 2 and "a" <= d[0] <= "z" and unicodedata.combining(d[1])), strict=True)
#: The combining marks that go, where a letter and its mark are two code points.
MARKS = "".join(chr(0x300 + i) for i in (*range(5), 6, 7, 8, 9, 10, 11, 12, 15, 17, 27, 35, 36, 37, 38, 39, 40, 45, 46, 48, 49))
WORD = r"[\p{L}\p{N}\p{Co}]+"

SECTION = T.ArrayType(T.StructType([T.StructField("idx", T.IntegerType()), T.StructField("heading", T.StringType()), T.StructField("body", T.StringType())]))
EXCERPT = T.StructType([T.StructField("text", T.StringType()), T.StructField("highlights", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])


def fold(text: Column) -> Column:
    """Lower case without marks; the slow letter-by-letter way is for texts that aren't ASCII alone."""
    low = F.lower(text)
    return F.when(F.octet_length(text) == F.length(text), low).otherwise(F.translate(low, "".join(MARKED) + MARKS, "".join(PLAIN)))


def tokens(text: Column) -> Column:
    """Words of letters, digits and private-use characters, folded; null gives none."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def fold_str(text: str) -> str:
    return text.lower().translate(dict(zip(map(ord, MARKED), PLAIN, strict=True)) | dict.fromkeys(map(ord, MARKS)))


def parse_query(query: str) -> list[str]:
    """Words and "quoted phrases" of a query. An open quote runs to the end; blank phrases go."""
    out = []
    for k, part in enumerate(query.split('"')):
        out += [part.strip()] if k % 2 else part.split()
    return [p for p in out if p]


def phrases(query: str) -> list[list[str]]:
    """The words of each part of a query: a part with punctuation inside is a phrase. Parts without words go."""
    split = [re.findall(r"(?:[^\W_]|[\ue000-\uf8ff\U000f0000-\U000ffffd\U00100000-\U0010fffd])+", fold_str(p)) for p in parse_query(query)]
    return [p for p in split if p]


def contains(text: Column, needle: str) -> Column:
    """Substring test without regard to case; null is no."""
    return F.coalesce(F.contains(F.lower(text), F.lit(needle.lower())), F.lit(False))


def has_all(text: Column, parts: list[str]) -> Column:
    """Every part is a substring; no parts are in every text."""
    out = F.lit(True)
    for p in parts:
        out = out & contains(text, p)
    return out


def single_spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def paragraphs(text: Column, separator: str = "\n\n") -> Column:
    """Trimmed, non-empty paragraphs."""
    trimmed = F.transform(F.split(text, separator), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.filter(trimmed, lambda p: p != "")


def strip_footer(markdown: Column, footer: str = "Chat with") -> Column:
    """Without the last line that starts with ``footer``, what follows it and a rule before it."""
    trimmed = F.regexp_replace(markdown, r"\s+$", "")
    cut = F.regexp_replace(trimmed, rf"(?s)^(.*)\n{re.escape(footer)}.*$", "$1")
    body = F.regexp_replace(F.regexp_replace(cut, r"\s+$", ""), r"---$", "")
    return F.when(F.contains(trimmed, F.lit("\n" + footer)), F.regexp_replace(body, r"\s+$", "")).when(F.startswith(trimmed, F.lit(footer)), F.lit("")).otherwise(trimmed)


_HEADING = re.compile(r"^(#{1,6}) (.*)$", re.MULTILINE)


def split_sections(markdown: str | None) -> list[tuple[int, str | None, str]]:
    """(position, heading, body) on the most frequent heading level, the deeper of equals; empty bodies go."""
    if not markdown or not markdown.strip():
        return []
    found = list(_HEADING.finditer(markdown))
    levels = [len(m[1]) for m in found]
    if not found:
        return [(0, None, markdown.strip())]
    level = max(set(levels), key=lambda n: (levels.count(n), n))
    marks = [m for m in found if len(m[1]) == level]
    parts = [(None, markdown[: marks[0].start()])]
    parts += [(m[2].strip(), markdown[m.end() : n.start() if n else len(markdown)]) for m, n in zip(marks, [*marks[1:], None], strict=True)]
    kept = [(h, b.strip()) for h, b in parts if b.strip()]
    return [(i, h, b) for i, (h, b) in enumerate(kept)]


@F.pandas_udf(SECTION)
def sections(markdown: pd.Series) -> pd.Series:
    return markdown.map(lambda m: [{"idx": i, "heading": h, "body": b} for i, h, b in split_sections(m)])


def _found(text: str, parts: list[str]) -> list[tuple[int, int]]:
    """Where the parts stand in ``text``, without regard to case. Letters whose lower case is longer count as they are."""
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    spans = set()
    for part in (p.lower() for p in parts if p):
        at = low.find(part)
        while at >= 0:
            spans.add((at, at + len(part)))
            at = low.find(part, at + len(part))
    return sorted(spans)


def excerpt_of(text: str, parts: list[str], width: int) -> tuple[str, list[tuple[int, int]]]:
    """Whole words around the first match, and where the parts are in them.

    Words before the match are taken while they fit a third of ``width``, words from it on while all fit ``width``, then more
    before it if the text ended. The word of the match is shown whatever its length. An ellipsis marks a cut end.
    """
    words = text.split()
    ends = list(accumulate(len(w) + 1 for w in words))  # each word's end in the line, with a space after it
    starts = [0, *ends[:-1]] if words else []
    line = " ".join(words)
    match = next(iter(_found(line, parts)), (0, 0))[0]
    here = max(0, bisect_right(starts, match) - 1)
    room = min(width // 3, max(0, width - len(words[here]))) if words else 0
    first = bisect_left(starts, starts[here] - room, 0, here) if words else 0
    last = max(here + 1, bisect_right(ends, starts[first] + width + 1)) if words else 0
    if last == len(words) and words:
        first = min(first, bisect_left(starts, len(line) - width))
    head, tail = "…" if first else "", "…" if last < len(words) else ""
    body = " ".join(words[first:last])
    return head + body + tail, [(a + len(head), b + len(head)) for a, b in _found(body, parts)]


def excerpt(text: Column, parts: list[str], width: int = 160) -> Column:
    """struct(text, highlights) of the shown excerpt; meant for a page of results."""

    @F.pandas_udf(EXCERPT)
    def shown(s: pd.Series) -> pd.DataFrame:
        rows = [excerpt_of(x or "", parts, width) for x in s]
        return pd.DataFrame({"text": [t for t, _ in rows], "highlights": [[{"start": a, "end": b} for a, b in h] for _, h in rows]})

    return shown(text)


def chat_url(markdown: Column, host: str) -> Column:
    """The address of the first link to ``host``; null without one."""
    return F.nullif(F.regexp_extract(markdown, rf"\]\((https://{re.escape(host)}/[^)]*)\)", 1), F.lit(""))


def without_chat_line(markdown: Column, host: str) -> Column:
    """Without the first line that links to ``host``, and a blank line before it."""
    line = rf"\]\(https://{re.escape(host)}/"
    cut = F.regexp_replace(markdown, rf"(?s)\A(.*?)(?:(?:^|(?<=\n))[ \t]*\n)?(?:^|(?<=\n))[^\n]*{line}[^\n]*(?:\n|\z)(.*)\z", "$1$2")
    return F.when(markdown.rlike(line), F.regexp_replace(cut, r"\s+$", "")).otherwise(markdown)


def speaker_prefix(text: Column, source: Column) -> Column:
    """``[You]`` before the microphone's words, ``[Other]`` before the system's; blank text is empty."""
    label = F.when(source == "microphone", F.lit("[You] ")).when(source == "system", F.lit("[Other] ")).otherwise(F.lit(""))
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.lit("")).otherwise(F.concat(label, text))


def speaker_label(source: Column, name: Column) -> Column:
    named = F.when(F.trim(F.coalesce(name, F.lit(""))) != "", name).otherwise(F.lit("Other"))
    return F.when(source == "microphone", F.lit("You")).when(source == "system", named)


def redacted(columns: list[str], keys: set[str]) -> Column:
    """A row as JSON, bulky values replaced by a note; nulls are left out."""
    return F.to_json(F.struct(*[F.when(F.col(c).isNotNull(), F.lit("[stored]")).alias(c) if c in keys else F.col(c) for c in columns]))


def estimated_tokens(chars: Column) -> Column:
    return F.floor(chars / 4 + F.lit(0.5)).cast("long")


#: Words of no content in titles.
STOPWORDS = ("a", "an", "the", "of", "in", "on", "at", "to", "for", "with", "and", "or")


def content_words(text: Column) -> Column:
    """Distinct words of two ASCII letters or digits and more, but for stopwords."""
    split = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: F.length(w) >= 2)
    return F.array_except(F.array_distinct(split), F.array(*[F.lit(w) for w in STOPWORDS]))


def plain_title(title: Column) -> Column:
    return F.lower(F.trim(title))
