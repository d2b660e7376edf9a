from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
import numpy as np
from pyspark.sql import functions as F

from quillspan.functions import dates, text, tiptap, vectors
from quillspan.operators import chunking

NOW = datetime(2025, 3, 12, 1, 30, tzinfo=timezone.utc)  # a Wednesday
WEST = timezone(timedelta(hours=-5))


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_query_parts():
    assert text.parse_query('a "b c" d') == ["a", "b c", "d"]
    assert text.parse_query('ab"cd"') == ["ab", "cd"]
    assert text.parse_query('x "open to the end') == ["x", "open to the end"]
    assert text.parse_query('"  " ""') == []
    assert text.phrases("q3-delivery École") == [["q3", "delivery"], ["ecole"]]
    assert text.phrases("-- !!") == []


def test_tokens_fold_marks_and_split_on_marks(spark):
    assert one(spark, text.tokens(F.lit("Don't C++ under_score ÉCOLE 日本語 café"))) == ["don", "t", "c", "under", "score", "ecole", "日本語", "cafe"]
    assert one(spark, text.tokens(F.lit(None).cast("string"))) == []


def test_footer(spark):
    f = lambda s: one(spark, text.strip_footer(F.lit(s)))
    assert f("## A\n\nbody\n\n---\n\nChat with us: x\n") == "## A\n\nbody"
    assert f("body\nChat with us") == "body"
    assert f("Chat with us") == ""
    assert f("a\nChat with x\nb\nChat with y") == "a\nChat with x\nb"
    assert f("plain  \n") == "plain"


def test_sections_take_the_most_frequent_level_and_the_deeper_of_equals():
    assert text.split_sections("# T\n\nintro\n\n## A\n\na\n\n## B\n\nb") == [(0, None, "# T\n\nintro"), (1, "A", "a"), (2, "B", "b")]
    assert text.split_sections("# T\n\n## A\n\nbody")[0][1:] == (None, "# T")
    assert text.split_sections("no heading") == [(0, None, "no heading")]
    assert text.split_sections("## A\n\n## B\n\nb") == [(0, "B", "b")]
    assert text.split_sections("") == text.split_sections(None) == []


def test_excerpt_window():
    long = "word " * 60 + "needle " + "tail " * 60
    shown, marks = text.excerpt_of(long, ["NEEDLE"], 60)
    assert shown.startswith("…") and shown.endswith("…") and len(shown) <= 62
    assert [shown[a:b] for a, b in marks] == ["needle"]
    assert text.excerpt_of("short  text", ["q"], 60) == ("short text", [])
    assert text.excerpt_of("", ["x"], 10) == ("", [])
    assert text.excerpt_of("a b " + "y" * 40, ["yy"], 10)[0] == "…" + "y" * 40
    assert text.excerpt_of("one two three four five six", ["six"], 12)[0] == "…five six"
    assert text.excerpt_of("İx needle", ["NEEDLE"], 60) == ("İx needle", [(3, 9)])
    r = np.random.default_rng(1)
    for _ in range(300):
        line = " ".join("x" * int(n) for n in r.integers(1, 9, 40)) + " hit " + " ".join("y" * int(n) for n in r.integers(1, 9, int(r.integers(1, 40))))
        shown, marks = text.excerpt_of(line, ["hit"], 40)
        body = shown.strip("…")
        assert len(body) <= 40 and body in line and marks == [(shown.index("hit"), shown.index("hit") + 3)]
        assert len(body) >= 40 - 18 and (shown.startswith("…") or line.startswith(body)) and (shown.endswith("…") or line.endswith(body))


def test_chat_link(spark):
    md = F.lit("body\n\n[talk](https://chat.example/t/1?x=2)\nmore")
    assert one(spark, text.chat_url(md, "chat.example")) == "https://chat.example/t/1?x=2"
    assert one(spark, text.without_chat_line(md, "chat.example")) == "body\nmore"
    assert one(spark, text.chat_url(F.lit("none"), "chat.example")) is None
    assert one(spark, text.without_chat_line(F.lit("none"), "chat.example")) == "none"


def test_speakers_and_redaction(spark):
    assert one(spark, text.speaker_label(F.lit("system"), F.lit(" "))) == "Other"
    assert one(spark, text.speaker_label(F.lit("microphone"), F.lit("Ann"))) == "You"
    assert one(spark, text.speaker_label(F.lit(None).cast("string"), F.lit("Ann"))) is None
    assert one(spark, text.speaker_prefix(F.lit("hi"), F.lit("system"))) == "[Other] hi"
    df = spark.createDataFrame([("1", "huge", None)], "id string, body string, gone string")
    assert df.select(text.redacted(["id", "body", "gone"], {"body", "gone"})).first()[0] == '{"id":"1","body":"[stored]"}'


def test_relative_dates():
    day = dates.relative("today", NOW, WEST)
    assert day.start == datetime(2025, 3, 11, 5, tzinfo=timezone.utc) and day.end - day.start == timedelta(days=1)
    assert dates.relative("this-week", NOW).start == datetime(2025, 3, 10, tzinfo=timezone.utc)
    assert dates.relative("last-week", NOW).end == datetime(2025, 3, 10, tzinfo=timezone.utc)
    assert dates.relative("last-month", NOW) == dates.DateRange(datetime(2025, 2, 1, tzinfo=timezone.utc), datetime(2025, 3, 1, tzinfo=timezone.utc))
    assert dates.relative("this-month", datetime(2025, 12, 31, tzinfo=timezone.utc)).end == datetime(2026, 1, 1, tzinfo=timezone.utc)
    assert dates.relative("someday", NOW) is None


def test_absolute_dates_and_durations():
    assert dates.absolute("2025-06-15T10:00:00-05:00") == datetime(2025, 6, 15, 15, tzinfo=timezone.utc)
    assert dates.absolute("2025-06-15", WEST) == datetime(2025, 6, 15, 5, tzinfo=timezone.utc)
    assert dates.absolute("15/06/2025") is None
    assert dates.ago("1m", datetime(2025, 3, 31, 12, tzinfo=timezone.utc)) == datetime(2025, 2, 28, tzinfo=timezone.utc)
    assert dates.ago("2w", NOW) == datetime(2025, 2, 26, tzinfo=timezone.utc)
    assert dates.ago("0d", NOW) is dates.ago("d", NOW) is dates.ago("3é", NOW) is None
    with pytest.raises(ValueError):
        dates.build_range("whenever", None, None, NOW)
    with pytest.raises(ValueError):
        dates.build_range(None, "soon", None, NOW)
    assert dates.build_range("today", "2020-01-01", None, NOW).start == datetime(2025, 3, 12, tzinfo=timezone.utc)


def test_cosine(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(2.0), F.lit(0.0))
    assert one(spark, vectors.cosine(a, b)) == 1.0
    assert one(spark, vectors.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0.0


def test_tiptap():
    import json

    t = lambda s, **k: {"type": "text", "text": s, **k}
    p = lambda *c: {"type": "paragraph", "content": list(c)}
    item = lambda *c: {"type": "listItem", "content": list(c)}
    doc = {
        "type": "doc",
        "content": [
            {"type": "heading", "attrs": {"level": 9}, "content": [t("H")]},
            p(t("a"), t("b", marks=[{"type": "bold"}, {"type": "link", "attrs": {"href": "u"}}])),
            {"type": "bulletList", "content": [item(p(t("x")), {"type": "orderedList", "attrs": {"start": 3}, "content": [item(p(t("y")))]}), item(p(t("z")), p(t("w")))]},
            {"type": "horizontalRule"},
            {"type": "mystery", "content": [p(t("kept"))]},
        ],
    }
    assert tiptap.to_markdown(json.dumps(doc)) == "###### H\n\na[**b**](u)\n\n- x\n  3. y\n- z\n  w\n\n---\n\nkept"
    deep = '{"content":[' + '{"type":"x","content":[' * 300 + '{"type":"text","text":"end"}' + ']}' * 300 + ']}'
    assert tiptap.to_markdown(deep) == "end"
    assert tiptap.to_markdown("{broken") is None and tiptap.to_markdown(None) is None


def rows(*texts, source="system"):
    return [{"text": t, "source": source, "start": i, "end": i + 1} for i, t in enumerate(texts)]


def test_windows_flush_at_the_target_and_carry_over():
    c = chunking.Config(max_tokens=50, target_tokens=25, overlap_tokens=5, min_chars=10)
    out = list(chunking.transcript_windows(rows("a" * 80, "b" * 80, "c" * 80), c))
    assert [w[1:3] for w in out] == [(0, 0), (1, 1), (2, 2)]
    assert out[1][0].startswith("a" * 20 + "\n[Other] bbb")
    assert all(len(w[0]) <= 200 for w in out)


def test_windows_of_oversized_utterances_stay_under_the_cap():
    c = chunking.Config(max_tokens=20, target_tokens=12, overlap_tokens=4, min_chars=5)
    out = list(chunking.transcript_windows(rows("One two three. " * 30, source=None), c))
    assert len(out) > 5 and all(chunking.size(w[0]) <= 80 for w in out)


def test_windows_never_hold_only_what_was_carried_over():
    c = chunking.Config(max_tokens=20, target_tokens=12, overlap_tokens=8, min_chars=1)
    out = [w[0] for w in chunking.transcript_windows(rows("x" * 76 + ".  ", source=None), c)]
    assert len(out) == len(set(out))
    assert list(chunking.transcript_windows(rows(" ", ""), c)) == []


def test_overlap_by_utterances_carries_whole_ones():
    c = chunking.Config(max_tokens=40, target_tokens=10, overlap_tokens=3, min_chars=1, mode="utterances")
    out = [w[0] for w in chunking.transcript_windows(rows("first one here", "second", "third is longer than it", source=None), c)]
    assert out[1].startswith("second\nthird")


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab é日.!? ", max_size=120), st.integers(1, 30))
def test_cuts_lose_no_words(s, limit):
    parts = chunking.cut_all(s, limit)
    assert "".join(parts).replace(" ", "") == s.replace(" ", "")
    assert all(chunking.size(p) <= limit or len(p) == 1 for p in parts)


def test_config():
    assert (chunking.Config().target, chunking.Config().overlap, chunking.Config().cap) == (1392, 408, 2048)
    assert chunking.Config.of_model(1000).target_tokens == 680
    with pytest.raises(ValueError):
        chunking.Config(target_tokens=600)


def test_header():
    h = chunking.header_of("Plan", "2025-06-15", ["Ann", "Bob"])
    assert h == "Meeting: Plan\nDate: 2025-06-15\nAttendees: Ann, Bob\n\n"
    assert chunking.header_of("", None, []) is None
    assert chunking.size(chunking.header_of("é" * 600, "2025-06-15", ["N" * 40] * 30)) <= 512


def test_words_of_all_scripts_fold_letters_of_one_mark_and_drop_marks(spark):
    from quillspan.functions.text import phrases, tokens

    text = "CAFE\u0301 café Ệ ṡ a\u0331b x\u0483y \ue000z ĄĘ ό"
    want = ["cafe", "cafe", "ệ", "s", "ab", "x", "y", "\ue000z", "ae", "ό"]
    got = spark.createDataFrame([(text,)], "t string").select(tokens(F.col("t")).alias("w")).first()["w"]
    assert got == want and [p for parts in phrases(text) for p in parts] == want
