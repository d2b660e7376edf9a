"""Spelling variants, main text and collocations against plain versions, and texts that once stopped the pseudonyms."""

import collections
import html
import re
import time
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspan.llm import chains, collocations, extraction, pii, registry, tokens, variants
from quillspan.llm.scratch import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def table(spark, rows):
    """rows: (doc_id, text, lang), with columns that operators might name so themselves."""
    full = [(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in rows]
    return spark.createDataFrame(full, DOCS).withColumns({c: F.lit(1) for c in ("word", "n", "h", "block", "rank", "key")})


@pytest.mark.parametrize("name", ["op1_mixing", "op3_embeddings", "op6_urls", "op9_minhash", "op11_variants", "op12_extraction", "op13_collocations"])
def test_queries_agree_with_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = con.sql(registry.ORACLES[name])
    assert sorted(want.columns) == names
    rounded = lambda rows: sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)
    assert rounded(map(tuple, got.select(*names).collect())) == rounded(want.select(", ".join(names)).fetchall())


# ---- 11 spelling variants


def plain_words(docs):
    found = collections.Counter()
    for i, t in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            found[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words):
    form, near = {}, {}
    for w in words:
        near[w] = [x for x in words if one_edit(w, x)]
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


@pytest.mark.parametrize("of_a_range", [3, 40, 100_000])
def test_variants_are_those_of_all_pairs_however_words_are_cut_into_ranges(spark, monkeypatch, of_a_range):
    monkeypatch.setattr(variants, "RANGE_WORDS", of_a_range)
    rng = np.random.default_rng(11)
    stems = ["aabbaab", "abababa", "aaaaaaa", "àbbbbbbé", "zzabcdefg", "bbbbbbbb", "abcdefgh"]
    words = set(stems)
    for _ in range(260):
        w = list(stems[rng.integers(len(stems))])
        for _ in range(rng.integers(1, 3)):
            at = int(rng.integers(len(w)))
            w[at : at + int(rng.integers(2))] = list(rng.choice(list("abàz"), rng.integers(3)))
        words.add("".join(w))
    docs = [(int(i), " ".join(w for w in words for _ in range(int(rng.choice([1, 2, 40]))))) for i in range(2)]
    docs += [(None, "Aabbaab-AABBAAB1aabbaab_"), (7, None), (8, ""), (9, "日aabbaab日 Àbbbbbbé"), (10, "q" * 5000 + " " + "q" * 5001), (11, "q" * 5000 + " " + "q" * 5001)]
    got = variants.variants(table(spark, [(i, t, "en") for i, t in docs]))
    rows = [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == plain_variants(plain_words(docs))


def test_variants_of_nothing(spark):
    assert variants.variants(table(spark, [])).count() == 0
    assert variants.variants(table(spark, [(1, "short wörds ünly", "en")])).count() == 0


def test_a_light_word_is_merged_at_few_nodes():
    words = sorted({bytes(x) for x in np.random.default_rng(5).integers(97, 101, (3000, 9)).astype(np.uint8)})
    merged = collections.Counter()
    for depth, starts, end in variants.branches(variants.neighbours_common(words)):
        children = variants._segments(words, depth, starts, end)
        heavy = variants._ranked(children)
        merged.update(i for s, e, c in children if c != heavy for i in range(s, e))
    assert max(merged.values()) <= np.log2(len(words))


# ---- 12 main text

STORY = "This is the story of a man who was in the house and did not have it all, as he said to us, on that day, and it was the end of it."


def test_main_text_leaves_out_what_is_not_the_article():
    page = f"""<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>x = "</p><p>{STORY}</p>"</script></head>
    <body class="has-sidebar"><header><h1>Site</h1><p>{STORY}</header><div id="cookie-notice"><p>{STORY}</div><!-- <p>{STORY}</p> -->
    <main><h1>Head &amp; more&nbsp;of  it</h1><p>Short.<p title="a > b">{STORY}<br>And <a href=x>a link</a> <b>too</b>
    <div class="ad">{STORY}</div><ul><li>one</li><li>two &lt;b&gt; &#233; &eacute;</ul>
    <form><p>{STORY}</form><aside>{STORY}</aside><p>Ti.</p><ul><li><a href=1>Tag one</a><li><a href=2>Tag two</a></ul>
    <section id=comments><article><p>{STORY}</article></section></main>
    <p>{STORY}</p><footer>&copy; x</footer></body></html>"""
    assert extraction.main_text(page).split("\n") == ["Head & more of it", "Short.", f"{STORY} And a link too", "one", "two <b> é é", "Ti."]


def test_pages_without_an_article_go_by_density_and_neighbours():
    page = f"<body><div>Site name</div><ul><li><a href=1>Home of it</a><li><a href=2>About</a></ul><h2>Head</h2><p>{STORY}</p><p>Ti.</p><p>{STORY}</p><div>{'xyzzy ' * 40}</div><div>© 2024 all of it</div>"
    assert extraction.main_text(page).split("\n") == ["Head", STORY, "Ti.", STORY]
    assert extraction.main_text(f"<p>{STORY}").split("\n") == [STORY]
    assert extraction.main_text("<article><p>Only.</article><footer>The end of it</footer>") == "Only."


@pytest.mark.parametrize("piece", ["<", "<!--", "<a href=\"", "&", "<p>a", "<div>", "<b", "=", "<x =\"", "</", "<![CDATA[", "<li class=x>", "<a>b", "</div>"])
def test_hostile_markup_is_read_in_linear_time(piece):
    began = time.perf_counter()
    extraction.main_text(piece * (1_000_000 // len(piece)) + "<p>end")
    assert time.perf_counter() - began < 15


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("p div li h2 td blockquote".split()), st.text(alphabet="ab &<>\"é\n ", max_size=12)), max_size=8))
def test_an_articles_blocks_come_whole_and_in_order(parts):
    page = "<nav><a href=x>menu</a></nav><article><p>" + STORY + "</p>" + "".join(f"<{t} title='{html.escape(x)}'>{html.escape(x)}</{t}>" for t, x in parts) + "</article>"
    assert extraction.main_text(page).split("\n") == [STORY, *[y for _, x in parts if (y := " ".join(x.split()))]]


def test_pages_table(spark):
    rows = [(1, "u", f"<article><p>{STORY}"), (1, "u", f"<article><p>{STORY}"), (2, None, None), (None, "", ""), (3, "v", "<nav>x</nav>"), (4, "w", "<article>" + f"<p>{STORY}</p>" * 20_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("x"))
    got = [tuple(r) for r in extraction.extract(pages).collect()]
    want = [(i, u, t, len(t)) for i, u, t in ((1, "u", STORY), (1, "u", STORY), (2, None, ""), (None, "", ""), (3, "v", ""), (4, "w", "\n".join([STORY] * 20_000)))]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and extraction.extract(pages.limit(0)).count() == 0


# ---- 13 collocations


def plain_collocations(docs, top=2000):
    f, total = collections.Counter(), collections.Counter()
    for _, text, lang in docs:
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^ \t]+", piece)
            total[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    candidates = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= 30}
    found = collections.defaultdict(list)
    for (lang, g), a in candidates.items():
        inside = lambda long: any(long[i : i + len(g)] == g for i in range(len(long) - len(g) + 1))
        if any(len(h) > len(g) and m == lang and inside(h) and 100 * b >= 80 * a for (m, h), b in candidates.items()):
            continue
        score, cut = min((2_000_000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k) for k in range(1, len(g)))
        found[lang].append((-score, -a, " ".join(g).encode(), f[lang, g[:cut]], f[lang, g[cut:]]))
    return {(lang, n, p.decode(), -a, l, r, total[lang], -s) for lang, rows in found.items() for n, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)}


@pytest.mark.parametrize(("held", "block"), [(1_000_000, 1 << 16), (50, 8)])
def test_collocations_are_those_of_counting_all(spark, monkeypatch, held, block):
    monkeypatch.setattr(collocations, "HELD", held)
    monkeypatch.setattr(collocations, "BLOCK", block)
    monkeypatch.setattr(collocations, "FAN", 2)
    rng = np.random.default_rng(13)
    words = ["New", "york", "city", "a", "A", "été", "日本", "the", "x y", "big"]
    docs = [(i, " ".join(f"{words[min(9, int(rng.exponential(3)))]}{rng.choice(['', '', '', '.', ',', chr(9), chr(10)])}" for _ in range(150)), [None, "en", "und", "fr"][i % 4]) for i in range(24)]
    docs += [(90, None, "en"), (91, "", None), (92, "..,\n \t", "fr"), (93, "aa aa aa aa " * 3000, "de"), (93, "aa aa aa aa " * 3000, "de")]
    got = [tuple(r) for r in collocations.collocations(table(spark, docs)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
    assert len(got) == len(set(got)) and set(got) == plain_collocations(docs)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(table(spark, [])).count() == 0
    assert collocations.collocations(table(spark, [(1, "once only", "en")])).count() == 0


def test_bitmaps_pass_all_that_was_put_in_and_few_others(spark):
    rng = np.random.default_rng(17)
    h, other = rng.integers(-(2**63), 2**63 - 1, (2, 9000))
    bits = collocations.Bits(spark.createDataFrame([(int(x),) for x in h], "h long"))
    assert bits(h).all() and bits(other).mean() < 0.01


def test_perfect_hashes_are_minimal_and_know_their_keys():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 5000):
        h, h2 = rng.integers(-(2**63), 2**63 - 1, n), rng.integers(0, 2**31, n)
        seeds, slots = collocations.perfect(h, h2)
        assert sorted(slots.tolist()) == list(range(n))
        assert (collocations.slots_of(h, h2, seeds, n) == slots).all()
        block = collocations._Block(collocations._build(pa.table({"block": np.zeros(n, dtype=np.int64), "h": h, "h2": h2})))
        assert block.find(h, h2)[1].all() and not block.find(h ^ 1, h2)[1].any() and not block.find(h, h2 ^ 1)[1].any()


def test_words_of_a_run_are_cut_at_marks_and_rows():
    column = pa.array(["Ab c.d  e\tf", "g", "", "h i"])
    _, _, data, offsets = next(tokens.pieces(column))
    words = collocations.Words(data, offsets, np.zeros(4, dtype=np.uint64))
    assert [[words.text(k, i) for i in np.flatnonzero(words.whole[k - 1])] for k in (1, 2, 3)] == [["ab", "c", "d", "e", "f", "g", "h", "i"], ["ab c", "d e", "e f", "h i"], ["d e f"]]


# ---- 5 pseudonyms of texts that are long or made to recur


@pytest.mark.parametrize("text", ["x@" + "b." * 3000 + "com 1", "." * 10**7 + " 123", "7" * 10**7, "a." * 10**6 + " 123", "ab12" * 10**6, " ".join("4105930718452360"[i % 16] for i in range(500))], ids=["labels", "dots", "digits", "a.", "hex", "spaced digits"])
def test_long_texts_are_rewritten_in_bounded_time(spark, text):
    began = time.perf_counter()
    out = pii.pseudonymise(table(spark, [(1, text, "en")]), "k").first()["text"]
    assert len(out) == len(text) and time.perf_counter() - began < 90


def test_addresses_of_many_labels(spark):
    texts = ["to jo.doe+x@a.b.c.example.org.", "x@y.z1", "a@b.com.1x", "n" * 200 + "@mail.example.com"]
    got = [r["n_email"] for r in pii.pseudonymise(table(spark, [(i, t, "en") for i, t in enumerate(texts)]), "k").orderBy("doc_id").collect()]
    assert got == [1, 0, 1, 1] and Path(SF).exists()


def test_parts_are_tested_by_some_of_their_words_before_their_words_are_joined():
    """Of unrelated parts with one match few pass; none is left out in which a passage is found."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        a, b = rng.integers(0, 1 << 16, (2, 150 + i % 47)).astype("<u2")
        at, s_at = 60 + i % 9, 55 + i % 7
        if i % 3 == 0:  # a passage, with every sixth word replaced, one dropped or added
            n = 30 + i % 40
            b[s_at - 25 : s_at + n] = a[at - 25 : at + n]
            b[s_at - 25 : s_at + n : 6] = 7
            if i % 2:
                b = np.delete(b, s_at + 12) if i % 4 == 1 else np.insert(b, s_at + 12, 9)
        b[s_at : s_at + chains.SEED] = a[at : at + chains.SEED]
        rows.append((a, b, at, s_at, i % 2))
    thin = pa.array([a.tobytes()[2 * odd :: 4] for a, _, _, _, odd in rows], pa.binary())
    line, odd = np.array([at - s_at for _, _, at, s_at, _ in rows]), np.array([odd for *_, odd in rows])
    spread = chains.SHIFT + np.arange(300) % 5
    kept = chains.may_repeat(thin, odd, pa.array([b.tobytes() for _, b, *_ in rows], pa.binary()), line - spread, line + spread, 50, 0.8)
    has = np.zeros(1 << 16, dtype=bool)
    found = np.array([bool(chains.found_in(a, b, np.array([at]), np.array([s_at]), 50, 0.8, has)) for a, b, at, s_at, _ in rows])
    assert found.sum() > 30 and kept[found].all()
    assert kept[np.arange(300) % 3 > 0].mean() < 0.1
    assert not len(chains.may_repeat(thin[:0], odd[:0], thin[:0], odd[:0], odd[:0], 50, 0.8))


def test_shuffled_files_go_when_a_table_is_kept(spark):
    """Disk held at once is that of one step."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    folders = [Path(str(f)) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shuffled = lambda: {f.name for folder in folders for f in folder.rglob("shuffle_*.data")}
    old = shuffled()
    kept = Scratch(spark, "test").keep(spark.range(1000).repartition(7), free=True)
    for _ in range(50):
        left = shuffled() - old
        if not left:
            break
        time.sleep(0.1)
    assert not left and kept.count() == 1000 and spark.conf.get(key, None) == before
