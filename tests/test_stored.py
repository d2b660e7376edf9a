"""Stored tables in key ranges with commits, and the stored positional index, against plain ones."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.operators import search, textindex
from quillspan.operators.textindex import TextIndex, search_top
from quillspan.plans import keyword
from quillspan.sources.commits import Commits, Conflict
from quillspan.sources.ranges import RangeTable
from quillspan.sources.store import Store

SCHEMA = "id string, updated_at string, v string, source_account_id string"


def rows_of(spark, pairs, at="1"):
    return spark.createDataFrame([(k, at, v, None) for k, v in pairs], SCHEMA)


def shown(table, at=None):
    return {r["id"]: r["v"] for r in table.read(at).collect()}


def test_a_commit_number_is_given_once(spark, tmp_path):
    log = Commits(spark, f"file://{tmp_path}/t")
    assert log.head() == (-1, {})
    log.commit(0, {"a": 1})
    with pytest.raises(Conflict):
        log.commit(0, {"a": 2})
    assert log.head() == (0, {"a": 1}) and log.numbers() == [0]


def test_a_row_rewrites_one_range(spark, tmp_path):
    table = RangeTable(spark, f"file://{tmp_path}/t", SCHEMA)
    assert table.read().count() == 0
    table.replace(rows_of(spark, [(str(i), "old") for i in range(200)]), bits=4)
    before = table.commits.head()[1]["ranges"]
    assert len(before) == 16
    assert table.upsert(rows_of(spark, [("7", "new"), ("8", "same")], "1").limit(0)) == {"inserted": 0, "updated": 0, "unchanged": 0}
    counts = table.upsert(rows_of(spark, [("7", "new")], "2").unionByName(rows_of(spark, [("8", "same"), (None, "x")])), "updated_at")
    after = table.commits.head()[1]["ranges"]
    assert counts == {"inserted": 0, "updated": 1, "unchanged": 1} and sum(before[r] != after[r] for r in before) == 1
    assert shown(table)["7"] == "new" and shown(table)["8"] == "old" and len(shown(table)) == 200 and shown(table, 0)["7"] == "old"
    assert [tuple(r) for r in table.changes(0).collect()] == [("7", "updated")]
    assert table.upsert(rows_of(spark, [("7", "newer")], "2"), "updated_at") == {"inserted": 0, "updated": 0, "unchanged": 1} and table.version() == 1
    assert table.upsert(rows_of(spark, [("n", "in"), ("n", "in")]), "updated_at")["inserted"] == 1
    assert table.remove(spark.createDataFrame([("n",), ("none",)], "id string")) == {"removed": 1}
    assert {(r["key"], r["action"]) for r in table.changes(1).collect()} == {("n", "inserted"), ("n", "removed")}
    want = shown(table)
    table.regroup(2)
    assert shown(table) == want and len(table.commits.head()[1]["ranges"]) == 4
    table.drop_before(table.version())
    assert shown(table) == want


def test_two_writers(spark, tmp_path):
    table = RangeTable(spark, f"file://{tmp_path}/t", SCHEMA)
    table.replace(rows_of(spark, [(str(i), "old") for i in range(64)]), bits=3)
    of = {r["id"]: r["r"] for r in table.read().select("id", table.range_of(F.col("id"), 3).alias("r")).collect()}
    other = next(k for k in of if of[k] != of["0"])
    commit, raced = table.commits.commit, []

    def late(n, content):  # another writer is first, each time
        if not raced:
            raced.append(RangeTable(spark, table.root, SCHEMA).upsert(rows_of(spark, [(other, "theirs")])))
        commit(n, content)

    table.commits.commit = late
    assert table.upsert(rows_of(spark, [("0", "ours")]))["updated"] == 1
    assert shown(table)["0"] == "ours" and shown(table)[other] == "theirs" and table.version() == 2

    def always(n, content):  # now always in the same range
        RangeTable(spark, table.root, SCHEMA).upsert(rows_of(spark, [("0", "theirs")]))
        commit(n, content)

    table.commits.commit = always
    with pytest.raises(Conflict):
        table.upsert(rows_of(spark, [("0", "lost")]), attempts=2)
    assert shown(table)["0"] == "theirs"


def test_writers_at_once_lose_nothing(spark, tmp_path):
    RangeTable(spark, f"file://{tmp_path}/t", SCHEMA).replace(rows_of(spark, [("x", "x")]), bits=2)
    one = lambda k: RangeTable(spark, f"file://{tmp_path}/t", SCHEMA).upsert(rows_of(spark, [(f"{k}-{i}", "v") for i in range(5)]), attempts=10)
    threads = [threading.Thread(target=one, args=(k,)) for k in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(shown(RangeTable(spark, f"file://{tmp_path}/t", SCHEMA))) == 16


def test_children_by_parent(spark, tmp_path):
    table = RangeTable(spark, f"file://{tmp_path}/t", "id string, document_id string, v int", "id", "document_id")
    child = lambda rows: spark.createDataFrame(rows, table.schema)
    table.replace_children(child([("a", "d1", 1), ("b", "d1", 2), ("c", "d2", 3), ("z", "d9", 9)]), spark.createDataFrame([("d1",), ("d2",)], "document_id string"))
    table.replace_children(child([("d", "d1", 4)]), spark.createDataFrame([("d1",), ("d3",)], "document_id string"))
    assert {(r["id"], r["v"]) for r in table.read().collect()} == {("d", 4), ("c", 3)}
    table.replace_children(child([]), spark.createDataFrame([("d1",), ("d2",)], "document_id string"))
    assert table.read().count() == 0


# ---- the keyword index

WORDS = "the of and idiot déjà vu alpha beta gamma delta version 2 x1".split()


def texts(seed, n, prefix=""):
    rng = np.random.default_rng(seed)
    return [(f"{prefix}{i}", " ".join(WORDS[min(len(WORDS) - 1, int(rng.exponential(3)))] for _ in range(int(rng.integers(0, 40))))) for i in range(n)]


def table_of(spark, pairs, live=lambda k: True):
    return spark.createDataFrame([(k, f"d{hash_of(k) % 37}", t, live(k)) for k, t in pairs], "row_id string, document_id string, text string, live boolean")


def hash_of(k):
    return sum(map(ord, k or "")) * 7 + len(k or "")


QUERIES = ["idiot", "the of", "\"of the\"", "DÉJÀ vu", "version-2 the", "the the", "nothing", "", "alpha \"beta gamma\" x1"]


def scores(df):
    return sorted((r["document_id"], round(r["score"], 9)) for r in df.collect())


def test_the_index_after_updates_and_removals_scores_as_the_rows_do(spark, tmp_path):
    index = TextIndex(spark, f"file://{tmp_path}/i", buckets=4)
    assert index.bm25("idiot").count() == 0 and index.top("idiot", 3)[0].count() == 0
    state = dict(texts(1, 300)) | {"null": None, "empty": ""}
    live = lambda k: k[-1] != "5"
    assert index.append(table_of(spark, state.items(), live).unionByName(table_of(spark, [(None, "idiot")], lambda k: True))) == 0
    changed = dict(texts(2, 80)) | dict(texts(3, 20, "new")) | {"null": "idiot at last"}
    gone = [str(i) for i in range(60, 120)] + ["unknown", None]
    index.append(table_of(spark, changed.items(), live), batch=4)
    index.append(table_of(spark, []), removed=spark.createDataFrame([(g,) for g in gone], "row_id string"), batch=5)
    assert index.append(table_of(spark, texts(9, 5)), batch=5) == 2 and index.seen() == 5
    state |= changed
    state = {k: v for k, v in state.items() if k not in gone}
    plain = table_of(spark, state.items(), live)
    for merged in (False, True):
        for q in QUERIES[2:4] if merged else QUERIES:
            assert scores(index.bm25(q)) == scores(search.bm25(plain, q)), q
        n = search.corpus_stats(plain).first()
        stat = index.statistics()
        assert (stat["rows"], stat["tokens"], stat["segments"]) == (n["n_rows"], n["n_tokens"], 1 if merged else 3)
        assert index.drift(plain).count() == 0 and {r["kind"]: r["n"] > 0 for r in index.drift(plain.filter("row_id <> '7'")).collect()} == {"stale": True}
        df = {r["term"]: r["df"] for r in index.frequencies().collect()}
        assert df == {r["term"]: r["df"] for r in search.document_frequencies(search.postings(plain)).collect()}
        index.merge()
    index.drop_unused()
    assert scores(index.bm25("the of")) == scores(search.bm25(plain, "the of"))
    documents = {r["document_id"] for r in plain.select("document_id").distinct().collect()}
    out = sorted(documents)[:5]
    index.append(table_of(spark, [("again", "idiot idiot")]), removed=spark.createDataFrame([(d,) for d in out], "document_id string"))
    left = plain.filter(~F.col("document_id").isin(out)).unionByName(table_of(spark, [("again", "idiot idiot")]))
    assert scores(index.bm25("idiot the")) == scores(search.bm25(left, "idiot the")) and scores(index.bm25("idiot")) == scores(search.bm25(left, "idiot"))


@pytest.mark.parametrize("k", [1, 20])
def test_the_first_k_are_those_of_the_whole_ranking(spark, tmp_path, monkeypatch, k):
    monkeypatch.setattr(textindex, "RANGE_BITS", 5)
    index = TextIndex(spark, f"file://{tmp_path}/i", buckets=4)
    state = texts(5, 3000) + [(f"s{i}", "the " * 30 + "idiot idiot idiot " + "x " * i) for i in range(3)]
    index.append(table_of(spark, state[:2000]))
    index.append(table_of(spark, state[1900:]))
    allowed = spark.createDataFrame([(f"d{i}",) for i in range(30)], "id string")
    for q in ("idiot", "gamma delta", "nothing") if k == 1 else ("the idiot", "\"the of\""):
        best = search.bm25(table_of(spark, state), q).groupBy("document_id").agg(F.min("score").alias("score")).filter(F.substring("document_id", 2, 9).cast("int") < 30)
        want = scores(best)
        kth = sorted(s for _, s in want)[: k][-1:] or [0]
        found, read = index.top(q, k, allowed)
        assert scores(found) == [x for x in want if x[1] <= kth[0]], q
        assert read["postings_read"] <= read["postings"]
    if k == 1:
        read = index.top("idiot", 1)[1]
        assert read["ranges_read"] < read["ranges"] / 4 and read["postings_read"] < read["postings"] / 4


def test_a_store_keeps_its_keyword_indexes(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    doc = lambda i, title, notes: (i, title, notes)
    put = lambda rows: store.table("documents").upsert(spark.createDataFrame([doc(*r) for r in rows], "id string, title string, notes_plain string"))
    put([("d1", "Plan of the year", "the idiot said"), ("d2", "Other", "nothing here")])
    said = lambda rows: spark.createDataFrame(rows, "id string, document_id string, text string")
    parents = lambda *ids: spark.createDataFrame([(i,) for i in ids], "document_id string")
    store.table("utterances").replace_children(said([("u1", "d2", "an idiot spoke"), ("u2", "d1", "hello")]), parents("d1", "d2"))
    assert keyword.refresh(store) == {"transcripts": True, "panels": False, "notes": True, "titles": True}
    assert not any(keyword.refresh(store).values())
    documents = store.read("documents").withColumn("created_at", F.current_timestamp())
    ids = lambda q, **k: sorted(r["id"] for r in search.search(documents, keyword.indexes(store), q, **k).collect())
    assert ids("idiot") == ["d1", "d2"] and ids("plan") == ["d1"] and ids("idiot", targets=("notes",)) == ["d1"]
    put([("d1", "Plan of the year", "changed")])
    store.table("utterances").replace_children(said([]), parents("d2"))
    assert keyword.refresh(store) == {"transcripts": True, "panels": False, "notes": True, "titles": True}
    assert ids("idiot") == [] and ids("changed") == ["d1"]
    allowed = store.read("documents").select("id")
    assert [r["id"] for r in search_top(documents, keyword.indexes(store), "hello", 5, allowed).collect()] == ["d1"]
    store.write("documents", store.read("documents").filter("id = 'd2'"))
    keyword.refresh(store)
    assert ids("changed") == [] and ids("other") == ["d2"]


# ---- vectors


def vector_chunks(spark, rng, clusters, each, dim):
    middle = rng.normal(size=(clusters, dim))
    rows = [(f"d{c}-{i % 7}", c * each + i, ["a", "b"][i % 2], [float(x) for x in middle[c] + 0.05 * rng.normal(size=dim)]) for c in range(clusters) for i in range(each)]
    rows += [("none", -1, "a", None), ("zero", -2, "a", [0.0] * dim), ("short", -3, "b", [1.0]), ("same", -4, "b", rows[0][3]), ("nan", -5, "b", [float("nan")] * dim)]
    return middle, spark.createDataFrame(rows, "document_id string, chunk_id long, source_type string, vector array<double>")


def test_vector_search_that_skips_gives_what_brute_force_gives(spark, tmp_path):
    from quillspan.operators import semantic
    from quillspan.operators.vectorindex import VectorIndex

    rng = np.random.default_rng(7)
    middle, chunks = vector_chunks(spark, rng, 40, 30, 16)
    chunks = chunks.filter("document_id <> 'nan'")
    index = VectorIndex(spark, f"file://{tmp_path}/v")
    index.build(chunks)
    asked = [(i, [float(x) for x in middle[i] + 0.02 * rng.normal(size=16)]) for i in range(3)]
    ranks = lambda df: sorted((r["query_id"], r["rank"], r["document_id"], r["chunk_id"], round(r["score"], 9)) for r in df.collect())
    allowed = chunks.select(F.col("document_id").alias("id")).distinct().filter("id not like '%-3'")
    for queries, options in ((asked, {}), (asked, {"sources": ["a"], "allowed": allowed}), ([*asked, (9, [0.0] * 16)], {}), (asked, {"min_score": 0.97, "limit": None}), ([(5, [float(x) for x in rng.normal(size=16)])], {"limit": 200})):
        q = spark.createDataFrame(queries, "query_id int, q array<double>")
        options = {"limit": 5} | options
        found, read = index.search(q, **options)
        assert ranks(found) == ranks(semantic.search(chunks, q, **options))
        assert read["chunks"] == chunks.count() and read["chunks_read"] <= read["chunks"]
        if queries is asked:
            assert read["chunks_read"] < read["chunks"] / 3


def test_bounds_hold(spark):
    from quillspan.operators.vectorindex import bounds, centres

    rng = np.random.default_rng(3)
    v = rng.normal(size=(2000, 5))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    c = centres(v, 12)
    of = np.argmax(v @ c.T, axis=1)
    angle = np.arccos(np.clip((v * c[of]).sum(axis=1), -1, 1))
    least, most = (np.array([f(angle[of == k]) for k in range(12)]) for f in (np.min, np.max))
    ceiling = bounds(v[:200], c, least, most)
    assert all((v[:200] @ v[of == k].T).max(axis=1)[i] <= ceiling[i, k] + 1e-9 for k in range(12) for i in range(200))
    assert (ceiling < 0.9).any()


# ---- chunks by the feed of changes


def test_only_changed_documents_are_cut_into_chunks(spark, tmp_path, monkeypatch):
    from quillspan.operators import chunking, embed
    from quillspan.plans import index

    store = Store(spark, f"file://{tmp_path}/store")
    long = lambda x: f"A paragraph about {x} that is long enough to be kept.\n\nAnother one about {x}, long enough as well."
    put = lambda rows: store.table("documents").upsert(spark.createDataFrame(rows, "id string, title string, notes_plain string"))
    put([(f"d{i}", f"T{i}", long(i)) for i in range(6)])
    seen = []
    whole = chunking.note_chunks

    def spy(documents, *a, **k):
        seen.append(sorted(r["id"] for r in documents.select("id").collect()))
        return whole(documents, *a, **k)

    monkeypatch.setattr(chunking, "note_chunks", spy)
    make = lambda: embed.byte_embedder(8)
    first = index.refresh(store, make, "bytes", 8)
    assert first["embed"] == store.read("chunks").count() == 12 and len(seen[-1]) == 6
    assert index.refresh(store, lambda: 1 / 0, "bytes", 8) == {"embed": 0, "refresh": 0, "unchanged": 12, "orphan": 0, "failed": 0} and seen[-1] == []
    put([("d1", "T1", long("news")), ("d9", "T9", long(9))])
    store.table("documents").remove(spark.createDataFrame([("d2",)], "id string"))
    before = store.table("chunks").commits.head()[1]["ranges"]
    assert index.refresh(store, make, "bytes", 8) == {"embed": 4, "refresh": 0, "unchanged": 8, "orphan": 2, "failed": 0}
    assert seen[-1] == ["d1", "d9"] and before != store.table("chunks").commits.head()[1]["ranges"]
    chunk = lambda: {(r["source_type"], r["source_id"], r["content_hash"]) for r in store.read("chunks").collect()}
    vector = lambda: {(r["source_type"], r["source_id"], tuple(r["vector"])) for r in store.read("embeddings").collect()}
    step = chunk(), vector()
    index.clear(store)
    assert index.refresh(store, make, "bytes", 8)["embed"] == 12 and (chunk(), vector()) == step
    assert index.refresh(store, make, "bytes", 8, headers=True)["embed"] == 12 and len(seen[-1]) == 6
    put([("d3", "T3", long("failing"))])

    def broken():
        raise RuntimeError("no model")

    class Failing:
        def __call__(self, texts):
            raise ValueError("no")

    assert index.refresh(store, Failing, "bytes", 8, headers=True)["failed"] > 0
    assert index.refresh(store, make, "bytes", 8, headers=True)["embed"] > 0 and store.read("chunks").count() == 12


# ---- opening a store


def test_an_old_store_is_brought_up_step_by_step(spark, tmp_path, monkeypatch):
    from quillspan.sources import migrations
    from quillspan.sources.schemas import VERSION

    assert max(migrations.STEPS) == VERSION
    new = migrations.open_store(spark, f"file://{tmp_path}/new")
    assert migrations.version(new) == VERSION
    old = Store(spark, f"file://{tmp_path}/old")
    old.table("documents").upsert(spark.createDataFrame([("d1", None), ("d2", "T")], "id string, title string"))
    snapshot = '{"detected_speaker_name":"Bob"}'
    old.table("utterances").replace_children(spark.createDataFrame([("u", "d1", None, snapshot), ("v", "d1", "Al", snapshot), ("w", "d1", None, None)], "id string, document_id string, speaker_name string, api_snapshot string"), spark.createDataFrame([("d1",)], "document_id string"))
    old.table("metadata").upsert(spark.createDataFrame([("schema_version", "1")], "key string, value string"))
    ran = []
    steps = {n: (lambda store, n=n, f=f: (ran.append(n), f(store))) for n, f in migrations.STEPS.items()}

    def fails(store):
        raise RuntimeError("lost")

    monkeypatch.setattr(migrations, "STEPS", steps | {3: fails})
    with pytest.raises(RuntimeError):
        migrations.open_store(spark, old.root)
    assert ran == [2] and migrations.version(old) == 2
    monkeypatch.setattr(migrations, "STEPS", steps)
    store = migrations.open_store(spark, old.root)
    migrations.open_store(spark, old.root)
    assert ran == [2, 3] and migrations.version(store) == 3
    assert {r["id"]: r["title"] for r in store.read("documents").collect()} == {"d1": "", "d2": "T"}
    assert {r["id"]: r["speaker_name"] for r in store.read("utterances").collect()} == {"u": "Bob", "v": "Al", "w": None}
    migrations.restore(store, 0)
    assert migrations.version(store) == 1 and {r["id"]: r["title"] for r in store.read("documents").collect()} == {"d1": None, "d2": "T"}
    old.table("metadata").upsert(spark.createDataFrame([("schema_version", "99")], "key string, value string"))
    with pytest.raises(ValueError, match="99"):
        migrations.open_store(spark, old.root)


def test_search_page_has_totals_chunks_and_deleted_ones(spark):
    from quillspan.plans import commands

    at = "timestamp '2025-01-01 00:00:00'"
    docs = spark.sql(f"select id, title, {at} as created_at, if(gone, {at}, null) as deleted_at, notes_plain from values ('a', 'Roadmap', 'the roadmap is here', false), ('b', 'Other', 'nothing', false), ('g', 'Gone', 'a roadmap', true) as t(id, title, notes_plain, gone)")
    panels = spark.createDataFrame([], "id string, document_id string, content_markdown string, deleted boolean")
    said = spark.createDataFrame([], "document_id string, seq long, start_timestamp timestamp, text string, source string, speaker_name string")
    chunks = spark.createDataFrame([(1, "a", "notes_paragraph", [1.0, 0.0], "far"), (2, "b", "notes_paragraph", [0.0, 1.0], "near it"), (3, "g", "notes_paragraph", [0.0, 1.0], "gone")], "chunk_id long, document_id string, source_type string, vector array<double>, text string")
    sources = {"notes": docs.selectExpr("id as document_id", "notes_plain as text")}
    page, total = commands.search_page(docs, panels, said, sources, chunks, "roadmap", [0.0, 1.0], limit=5)
    cards = {r["id"]: r for r in page.collect()}
    assert total.first()[0] == 1 and set(cards) == {"a", "b"}
    assert cards["a"]["signal_keyword"] and cards["a"]["signal_title"] and cards["a"]["best_chunk"] == 1 and cards["a"]["total_matches"] == 1
    assert not cards["b"]["signal_keyword"] and cards["b"]["best_chunk"] == 2 and cards["b"]["chunk_evidence"]["excerpt"]["text"] == "near it"
    page, total = commands.search_page(docs, panels, said, sources, chunks, "roadmap", [0.0, 1.0], limit=1, include_deleted=True)
    assert total.first()[0] == 2 and [r["id"] for r in page.collect()] == ["g"]
    one = commands.search_envelope(page, total, "roadmap", 1).first()
    assert (one["keyword_total"], one["limit"], one["returned"]) == (2, 1, 1) and one["meetings"][0]["id"] == "g"
    with pytest.raises(ValueError):
        commands.search_page(docs, panels, said, sources, chunks, "x", [0.0, 1.0], limit=0)


def test_a_segment_is_made_without_a_shuffle_of_postings(spark, tmp_path):
    """Runs of few words: postings are sorted in each, ranges are counted once, and the text is all that moves."""
    rows = [(f"r{i}", f"d{i}", " ".join(f"w{(i * j) % 17}" for j in range(i % 40))) for i in range(200)]
    before = textindex.RUN_TOKENS
    try:
        textindex.RUN_TOKENS = 100
        index = TextIndex(spark, f"file://{tmp_path}/i")
        index.append(spark.createDataFrame(rows, "row_id string, document_id string, text string"))
    finally:
        textindex.RUN_TOKENS = before
    postings = index.postings()
    once = postings.filter("n is not null").groupBy("term", "range").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    made = postings.groupBy("term", "range").agg(F.count("*").alias("m"))
    assert made.join(once, ["term", "range"], "left").filter("k is null or k <> 1 or n <> m").count() == 0 and made.select("range").distinct().count() > 8
    want = {(r, w): [j for j, x in enumerate(t.split()) if x == w] for r, _, t in rows for w in set(t.split())}
    assert {(r["row_id"], r["term"]): r["positions"] for r in postings.collect()} == want
    assert not list(tmp_path.glob("i/*/blocks")) and not list(tmp_path.glob("i/*/words"))
