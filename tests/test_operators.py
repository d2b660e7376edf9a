import json
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.functions.dates import DateRange
from quillspan.operators import chunking, embed, evaluation, evidence, fusion, ingest, listing, rerank, search, semantic, sinks, stats, transcripts
from quillspan.plans import commands
from quillspan.sources import landing, schemas
from quillspan.streaming.ingest import SnapshotSink


@pytest.fixture(scope="module")
def meetings(spark):
    docs = spark.createDataFrame(
        [
            ("doc-alpha", "Alpha planning", datetime(2025, 6, 15, 10), None, "Roadmap review.\n\nBudget talk: roadmap items."),
            ("doc-beta", "Beta retro", datetime(2025, 7, 20, 10), None, "What went well.\n\nNext steps"),
            ("doc-gamma", "Gamma planning", datetime(2025, 8, 10, 10), None, "Roadmap review."),
            ("doc-gone", "Roadmap of old", datetime(2025, 8, 11, 10), datetime(2025, 9, 1), "roadmap roadmap"),
        ],
        "id string, title string, created_at timestamp, deleted_at timestamp, notes_plain string",
    )
    utts = spark.createDataFrame(
        [
            ("u1", "doc-alpha", 1, "microphone", None, "shall we start", datetime(2025, 6, 15, 10)),
            ("u2", "doc-alpha", 2, "system", "Priya Raman", "the roadmap first", datetime(2025, 6, 15, 10, 1)),
            ("u3", "doc-alpha", 3, "system", "Priya Nair", "agreed", datetime(2025, 6, 15, 10, 2)),
            ("u4", "doc-beta", 1, None, None, "roadmap again", datetime(2025, 7, 20, 10)),
        ],
        "id string, document_id string, seq int, source string, speaker_name string, text string, start_timestamp timestamp",
    ).withColumn("end_timestamp", F.col("start_timestamp") + F.expr("interval 30 seconds"))
    panels = spark.createDataFrame([("p1", "doc-beta", "## Plan\n\nthe roadmap\n\n## Other\n\nnothing\n\n---\n\nChat with us", False)], "id string, document_id string, content_markdown string, deleted boolean")
    return docs, utts, panels


def ids(df, column="id"):
    return [r[column] for r in df.collect()]


def sources(docs, utts):
    return {"notes": docs.select(F.col("id").alias("document_id"), F.col("notes_plain").alias("text")), "titles": docs.select(F.col("id").alias("document_id"), F.col("title").alias("text")), "transcripts": utts.select("document_id", "text")}


def test_search_ranks_by_best_row_then_newest(meetings):
    docs, utts, _ = meetings
    found = ids(search.search(docs, sources(docs, utts), "roadmap review", targets=("notes",)))
    assert found == ["doc-gamma", "doc-alpha"]  # equal scores: the newer first
    assert "doc-gone" in ids(search.search(docs, sources(docs, utts), "roadmap", include_deleted=True))
    assert ids(search.search(docs, sources(docs, utts), '"first roadmap"')) == []
    assert ids(search.search(docs, sources(docs, utts), "!!")) == []
    assert ids(search.search(docs, sources(docs, utts), "roadmap", dates=DateRange(datetime(2025, 7, 1), datetime(2025, 8, 1)))) == ["doc-beta"]
    with pytest.raises(ValueError):
        search.search(docs, sources(docs, utts), "x", targets=("mail",))


def test_overlapping_phrases_are_all_counted(spark):
    rows = spark.createDataFrame([("a", "of of of the"), ("b", None)], "document_id string, text string")
    words = rows.select(search.occurrences(search.tokens(F.col("text")), ["of", "of"]).alias("n"))
    assert [r["n"] for r in words.collect()] == [2, 0]


def test_postings_agree_with_the_scan_and_drift_is_seen(meetings):
    docs, utts, _ = meetings
    rows = sources(docs, utts)["notes"].withColumn("row_id", F.col("document_id"))
    index = search.postings(rows)
    s = search.corpus_stats(rows).first()
    asked = docs.sparkSession.createDataFrame([(1, "roadmap"), (1, "review")], "query_id int, term string")
    by_index = {r["document_id"]: round(r["score"], 9) for r in search.search_postings(index, s["n_rows"], s["n_tokens"] / s["n_rows"], asked).collect()}
    by_scan = {r["document_id"]: round(r["score"], 9) for r in search.bm25(rows, "roadmap review").collect()}
    assert by_index == by_scan
    assert search.index_drift(index, rows).count() == 0
    assert search.index_drift(index.filter("term <> 'roadmap'"), rows).first()["kind"] == "missing"


def test_lookups(meetings):
    docs, _, _ = meetings
    assert ids(listing.show_meeting(docs, "doc-beta")) == ["doc-beta"]
    assert ids(listing.show_meeting(docs, "planning")) == ["doc-alpha"]
    assert listing.resolve_document(docs, "doc-g").first()["ambiguous"]
    assert not listing.resolve_document(docs, "doc-gamma").first()["ambiguous"]
    assert not listing.resolve_document(docs, "zzz").first()["found"]
    assert ids(listing.fetch_in_order(docs, ["doc-gone", "x", "doc-alpha"])) == ["doc-gone", "doc-alpha"]
    with pytest.raises(ValueError):
        listing.find_person(docs, " ")


def test_speakers(meetings):
    _, utts, _ = meetings
    assert transcripts.resolve_names(utts, "priya") == ["Priya Nair", "Priya Raman"]
    assert transcripts.resolve_names(utts, "PRIYA NAIR") == ["Priya Nair"]
    with pytest.raises(ValueError, match="Priya Raman"):
        transcripts.resolve_names(utts, "zoe")
    assert transcripts.show_speaker(utts, "doc-none", "me")[1] == "no transcript"
    assert transcripts.show_speaker(utts, "doc-beta", "me")[1] == "not in transcript"


def test_grep_shapes_evidence(meetings):
    docs, utts, panels = meetings
    page, total = commands.grep(docs, panels, utts, sources(docs, utts), "roadmap", matches=1, context=1)
    cards = {r["id"]: r for r in page.collect()}
    assert total.first()[0] == 3 == len(cards)
    beta = cards["doc-beta"]
    assert beta["total_matches"] == 2 and beta["matches"][0]["source"] == "panel" and beta["matches"][0]["section"] == "Plan" and beta["remaining"] == ["transcript"]
    assert beta["matches"][0]["context_after"] == ["nothing"]
    assert "+1 more" in sinks.card(1, {**beta.asDict(recursive=True)})
    page, total = commands.grep(docs, panels, utts, sources(docs, utts), "roadmap", speaker="priya")
    assert ids(page) == ["doc-alpha"] and total.first()[0] == 1
    with pytest.raises(ValueError):
        commands.grep(docs, panels, utts, sources(docs, utts), "x", targets=("notes",), speaker="me")


def test_matches_zero_keeps_totals(meetings):
    docs, utts, panels = meetings
    sites = evidence.all_sites(docs, panels, utts, "roadmap")
    card = evidence.shape(docs.filter("id = 'doc-beta'"), sites, "roadmap", max_matches=0).first()
    assert card["total_matches"] == 2 and card["matches"] is None
    assert evidence.all_sites(docs, panels, utts, "").count() == 0


def test_chunk_stands_in_for_missing_matches(spark, meetings):
    docs, utts, panels = meetings
    best = spark.createDataFrame([("doc-gamma", "notes_paragraph", "something near"), ("doc-beta", "unknown", "x")], "document_id string, source_type string, chunk_text string")
    cards = {r["id"]: r for r in evidence.shape(docs, evidence.all_sites(docs, panels, utts, "zebra"), "zebra", best).collect()}
    assert cards["doc-gamma"]["chunk_evidence"]["source"] == "notes" and cards["doc-gamma"]["total_matches"] == 1
    assert cards["doc-beta"]["chunk_evidence"] is None and cards["doc-alpha"]["total_matches"] == 0


def test_fusion_ties_and_repeats(spark):
    lists = spark.createDataFrame([(0, "k", "b", 1), (0, "k", "b", 9), (0, "s", "a", 1), (0, "s", "c", 3), (0, "k", "c", 3)], "query_id int, list string, document_id string, rank int")
    out = {r["document_id"]: r for r in fusion.rrf(lists).collect()}
    assert abs(out["b"]["rrf"] - 1 / 61) < 1e-12 and out["c"]["fused_rank"] == 1
    assert (out["a"]["fused_rank"], out["b"]["fused_rank"]) == (2, 3)


def test_ordering_never_changes_the_score(spark):
    rows = spark.createDataFrame([(0.4, 0.01, 1.0)], "score double, rrf double, title_signal double")
    out = fusion.ordering(rows).first()
    assert out["score"] == 0.4 and abs(out["order_score"] - 0.9) < 1e-9
    assert fusion.ordering(rows, 0.0, 0.0).first()["order_score"] == 0.4


def test_hybrid_search_fast_and_reranked(spark, meetings):
    docs, utts, _ = meetings
    chunks = spark.createDataFrame([(1, "doc-alpha", "notes_paragraph", [1.0, 0.0], "roadmap"), (2, "doc-beta", "notes_paragraph", [0.9, 0.1], "roadmap roadmap"), (3, "doc-gone", "notes_paragraph", [1.0, 0.0], "x")], "chunk_id long, document_id string, source_type string, vector array<double>, text string")
    fast = commands.hybrid_search(docs, sources(docs, utts), chunks, "roadmap", [1.0, 0.0])
    assert "doc-gone" not in ids(fast, "document_id") and fast.first()["score"] is None
    best = commands.hybrid_search(docs, sources(docs, utts), chunks, "roadmap", [1.0, 0.0], score=rerank.count_score("roadmap"))
    assert best.first()["document_id"] == "doc-beta"
    with pytest.raises(ValueError):
        commands.hybrid_search(docs, sources(docs, utts), chunks, "x", [1.0, 0.0], min_score=0.5)


def test_model_score_is_a_sigmoid(spark):
    df = spark.createDataFrame([("a",), (None,)], "t string")
    score = rerank.model_score("q", lambda: lambda q, texts: [0.0] * len(texts))
    assert [r[0] for r in df.select(score(F.col("t"))).collect()] == [0.5, 0.5]


def test_semantic_ties_and_targets(spark):
    chunks = spark.createDataFrame([(2, "a", "panel_section", [1.0, 0.0]), (1, "a", "panel_section", [2.0, 0.0]), (3, "b", "notes_paragraph", [-1.0, 0.0]), (4, "c", "notes_paragraph", [0.0, 0.0])], "chunk_id long, document_id string, source_type string, vector array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, q array<double>")
    out = semantic.search(chunks, q).collect()
    assert [(r["document_id"], r["chunk_id"]) for r in out] == [("a", 1), ("c", 4)]
    assert semantic.source_filter(("titles",)) == [] and semantic.source_filter(("transcripts", "panels", "notes")) is None
    assert semantic.search(chunks, q, sources=[]).count() == 0


def test_evaluation(spark):
    results = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 11)], "query_id int, document_id string, rank int")
    labels = spark.createDataFrame([(1, "b"), (1, "z"), (2, "c"), (3, "q")], "query_id int, label string")
    s = {r["query_id"]: r for r in evaluation.query_scores(results, labels).collect()}
    assert (s[1]["rr"], s[1]["recall"], s[2]["hit"], s[2]["best_rank"], s[3]["best_rank"]) == (0.5, 0.5, 0, 11, None)
    w = evaluation.win_loss_tie(evaluation.query_scores(results, labels), evaluation.query_scores(results.filter("query_id = 1"), labels)).first()
    assert (w["wins"], w["losses"], w["ties"]) == (1, 0, 2)


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1, None, "x"), ("b", 1, "t1", "x"), ("c", 1, "t1", "x")], "id string, v int, updated_at string, source_account_id string")
    new = spark.createDataFrame([("a", 2, None, "y"), ("b", 2, "t2", "y"), ("d", 2, "t1", "y"), (None, 9, "t1", "y")], "id string, v int, updated_at string, source_account_id string")
    out = {r["id"]: (r["v"], r["source_account_id"]) for r in ingest.upsert(old, new).collect()}
    assert out == {"a": (1, "x"), "b": (2, "x"), "c": (1, "x"), "d": (2, "y")}
    again = ingest.upsert_stats(ingest.classify(ingest.upsert(old, new), new)).first()
    assert (again["inserted"], again["updated"]) == (0, 0)


def test_calendars_metadata_and_accounts(spark):
    stored = spark.createDataFrame([("a", "old")], "id string, summary string")
    got = spark.createDataFrame([("a", "new", False), ("b", "b", False), ("c", "c", True)], "id string, summary string, selected boolean")
    assert {r["id"]: r["summary"] for r in ingest.upsert_calendars(stored, got).collect()} == {"a": "new", "c": "c"}
    meta = spark.createDataFrame([("last_sync_documents", "1")], "key string, value string")
    assert ingest.last_sync(ingest.stamp(meta, "documents", "2"), "documents").first()[0] == "2"
    none = spark.createDataFrame([], "account_id string, user_id string, email string, first_seen_at timestamp")
    one = ingest.log_account(none, "a", "u", "e", "2025-01-01T00:00:00Z")
    assert ingest.log_account(one, "a", "u", "e", "2026-01-01T00:00:00Z").first()["first_seen_at"].year == 2025
    assert ingest.empty_account(0, stored) and ingest.empty_account(1, stored) is None


def test_freshness(spark):
    def meta(**kv):
        return spark.createDataFrame(list(kv.items()) or [("x", "y")], "key string, value string")

    base = {"model_name": "m", "chunking_target_tokens": "348"}
    want = {"chunking_target_tokens": "348"}
    assert stats.freshness(meta(), 0, "m", want) == "Empty"
    assert stats.freshness(meta(model_name="n"), 1, "m", want) == "ModelMismatch"
    assert stats.freshness(meta(model_name="m"), 1, "m", want) == "LegacyChunking"
    assert stats.freshness(meta(**base, last_sync_panels="2025-01-02T00:00:00Z", embedded_sync_watermark="2025-01-01T00:00:00Z"), 1, "m", want) == "Stale"
    assert stats.freshness(meta(**base, last_sync_panels="2025-01-02T00:00:00Z", embedded_sync_watermark="2025-01-02T00:00:00+00:00"), 1, "m", want) == "Fresh"


def test_embedding_batches_fail_apart(spark):
    chunks = spark.createDataFrame([("t", str(i), "bad" if i == 3 else "good") for i in range(6)], "source_type string, source_id string, text string").coalesce(1)

    def make():
        good = embed.byte_embedder(8)

        def model(texts):
            if "bad" in texts:
                raise RuntimeError("no")
            return good(texts)

        return model

    out = embed.embed(chunks, make, batch=2).collect()
    assert sum(r["vector"] is None for r in out) == 2 and all((r["error"] is None) == (r["vector"] is not None) for r in out)
    assert embed.watermark(spark.createDataFrame(out), "s") is None
    v = embed.byte_embedder(4)(["ab", ""])
    assert abs(float((v[0] ** 2).sum()) - 1) < 1e-6 and not v[1].any()


def test_transcript_chunks(spark, meetings):
    _, utts, _ = meetings
    c = chunking.Config(min_chars=5)
    out = {r["source_id"]: r for r in chunking.transcript_chunks(utts, c).collect()}
    assert out["doc-alpha:w0"]["text"] == "[You] shall we start\n[Other] the roadmap first\n[Other] agreed"
    assert json.loads(out["doc-alpha:w0"]["metadata_json"])["speakers"] == ["Priya Raman", "Priya Nair"]


def test_panel_and_note_chunks(meetings):
    docs, _, panels = meetings
    c = chunking.Config(min_chars=5)
    assert {r["source_id"]: r["text"] for r in chunking.panel_chunks(panels, c).collect()} == {"p1:s0": "Plan\n\nthe roadmap", "p1:s1": "Other\n\nnothing"}
    assert {r["source_id"] for r in chunking.note_chunks(docs).collect()} == {"doc-alpha:n0"}
    cut = chunking.note_chunks(docs, chunking.Config(max_tokens=3, target_tokens=2, overlap_tokens=0, min_chars=2))
    assert all(chunking.size(r["text"]) <= 12 for r in cut.collect())


def test_landing(spark, tmp_path):
    def put(name, value):
        (tmp_path / name).write_text(json.dumps(value))
        return str(tmp_path / name)

    docs = landing.documents(spark, put("d.json", {"docs": [{"id": "1", "title": None, "created_at": "2025-06-15T10:00:00.000Z", "type": "meeting", "odd": 1}, {"id": "2", "created_at": "garbage"}]}))
    assert [(r["title"], r["doc_type"], r["created_at"] is None) for r in docs.orderBy("id").collect()] == [("", "meeting", False), ("", None, True)]
    evs = landing.events(spark, put("e.json", {"results": {"events": [{"id": "e", "start": {"dateTime": "2025-06-15T10:00:00-05:00"}, "calendar_id": "c"}]}}))
    assert evs.first()["start_time"] == datetime(2025, 6, 15, 15) and evs.first()["calendar_id"] == "c"
    rec = landing.recipes(spark, put("r.json", {"publicRecipes": [{"id": "r1", "slug": "s"}], "userRecipes": [{"id": "r2", "visibility": "odd"}]}))
    assert {r["id"]: r["visibility"] for r in rec.collect()} == {"r1": "public", "r2": "odd"}
    cal = landing.selected_calendars(spark, put("c.json", {"calendars_selected": {"a": True, "b": False}, "enabled_calendars": [{"id": "a", "accessRole": "owner"}]}))
    assert {r["id"]: (r["selected"], r["access_role"]) for r in cal.collect()} == {"a": (True, "owner"), "b": (False, None)}
    pan = landing.panels(spark, put("p.json", [{"id": "p", "document_id": "1", "content": json.dumps({"type": "doc", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "hi"}]}]})}]))
    assert pan.first()["content_markdown"] == "hi"
    people = spark.createDataFrame([("1", json.dumps({"creator": {"name": "Al", "email": "a@x"}, "attendees": [{"email": "b@x", "name": "short", "details": {"person": {"name": {"fullName": "Bob Full"}}}}]}))], "id string, people_json string")
    assert {(r["role"], r["full_name"]) for r in landing.document_people(people).collect()} == {("creator", "Al"), ("attendee", "Bob Full")}
    gold = landing.golden_set(spark, put("g.json", {"queries": [{"query": "q", "relevant_meeting_ids": ["1", "2"]}, {"query": "r", "relevant_meetings": ["T"]}]}))
    assert gold.count() == 3
    with pytest.raises(ValueError):
        landing.golden_set(spark, put("h.json", {"queries": [{"query": " ", "relevant_meetings": ["T"]}]}))


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b", None), (1, "a", "x")], "pos int, id string, note string")
    env = sinks.envelope(rows, spark.createDataFrame([(7,)], "n int"), "q", 10).first()
    assert env["total_meetings"] == 7 and [m["id"] for m in env["meetings"]] == ["a", "b"]
    assert {r[0] for r in sinks.json_rows(rows.select("id", "note")).collect()} == {'{"id":"b"}', '{"id":"a","note":"x"}'}
    m = spark.createDataFrame([(0.5,)], "mrr double")
    first = sinks.record_run(m, f"{tmp_path}/ledger", f"{tmp_path}/runs", "r")
    assert sinks.record_run(m, f"{tmp_path}/ledger", f"{tmp_path}/runs", "r") == f"{first}-2"
    assert spark.read.json(f"{tmp_path}/ledger").count() == 2
    sinks.dump_candidates(spark.createDataFrame([(1, "a", 1, 0.5)], "query_id int, document_id string, rank int, score double"), f"{tmp_path}/dump")
    assert spark.read.json(f"{tmp_path}/dump").first()["candidates"][0]["document_id"] == "a"
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.bin").write_bytes(b"abcdef")
    import hashlib

    want = hashlib.sha256(hashlib.sha256(b"abcd").digest() + hashlib.sha256(b"ef").digest()).hexdigest()
    assert sinks.content_hashes(spark, f"{tmp_path}/f", block=4).first()["hash"] == want


def test_schema_check(spark):
    df = spark.createDataFrame([], schemas.TABLES["metadata"])
    assert schemas.missing_columns(df, "metadata") == [] and schemas.missing_columns(df.drop("value"), "metadata") == ["value"]


def test_streaming_ingest(spark, tmp_path):
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("id string, updated_at string, body string")
    landing_dir = tmp_path / "in"
    landing_dir.mkdir()
    sink = SnapshotSink(spark, f"{tmp_path}/out", schema, text="body")
    assert sink.current() == -1 and sink.read().count() == 0
    (landing_dir / "1.json").write_text('{"id":"a","updated_at":"1","body":"one two"}\n{"id":"b","updated_at":"1","body":"x"}\n')
    sink.start(str(landing_dir), f"{tmp_path}/ck", available_now=True).awaitTermination()
    (landing_dir / "2.json").write_text('{"id":"a","updated_at":"2","body":"three"}\n{"id":"a","updated_at":"1","body":"late"}\n')
    sink.start(str(landing_dir), f"{tmp_path}/ck", available_now=True).awaitTermination()
    assert {r["id"]: r["body"] for r in sink.read().collect()} == {"a": "three", "b": "x"}
    assert {r["term"] for r in sink.read("postings").collect()} == {"three", "x"}
    before = sink.current()
    sink.write(spark.createDataFrame([("z", "1", "z")], schema), before)  # a batch that ran already
    assert sink.read().count() == 2


def test_sync_and_index(spark, tmp_path):
    from quillspan.plans import index, messages, sync
    from quillspan.sources.store import Store

    zone = tmp_path / "zone"

    def put(name, value):
        (zone / name).mkdir(parents=True, exist_ok=True)
        (zone / name / "r.json").write_text(json.dumps(value))

    doc = {"id": "d1", "title": "T", "created_at": "2025-06-15T10:00:00Z", "updated_at": "2025-06-15T10:00:00Z", "notes_plain": "A paragraph that is long enough.\n\nshort"}
    put("documents", {"docs": [doc]})
    put("people", [{"id": "p", "name": "Ann"}])
    put("utterances", [{"id": "u", "document_id": "d1", "text": "hello there, this is said and it is long enough to be a chunk", "start_timestamp": "2025-06-15T10:00:00Z", "source": "system"}, {"id": None, "document_id": "d1", "text": "no id"}, {"id": "x", "document_id": "unknown", "text": "lost"}])
    store = Store(spark, str(tmp_path / "store"))
    got = sync.full_sync(store, str(zone), "2025-07-01T00:00:00Z", account="acc")
    assert got["documents"]["inserted"] == 1 and "error" in got["events"] and "error" in got["panels"]
    assert [r["id"] for r in store.read("utterances").collect()] == ["u"]
    assert store.read("documents").first()["source_account_id"] == "acc"
    assert sync.full_sync(store, str(zone), "2025-07-02T00:00:00Z", only=["documents"])["documents"] == {"inserted": 0, "updated": 0, "unchanged": 1}
    assert {r["kind"] for r in sync.work_list(store).collect()} == {"panels"}
    put("documents", {"docs": []})
    assert "right account" in sync.full_sync(store, str(zone), "2025-07-03T00:00:00Z", only=["documents"])["documents"]["error"]

    make = lambda: embed.byte_embedder(16)
    first = index.refresh(store, make, "bytes", 16)
    assert first == {"embed": 2, "refresh": 0, "unchanged": 0, "orphan": 0, "failed": 0}

    def never():
        raise AssertionError("no model is needed")

    assert index.refresh(store, never, "bytes", 16)["unchanged"] == 2
    assert stats.freshness(store.read("metadata"), 2, "bytes", chunking.Config().notes()) == "Fresh"
    stamped = ingest.stamp(store.read("metadata"), "panels", "2030-01-01T00:00:00Z")
    state = stats.freshness(stamped, 2, "bytes", chunking.Config().notes())
    assert state == "Stale" and messages.freshness_warning(state)
    assert index.refresh(store, make, "other", 16)["embed"] == 2
    index.clear(store, newest=1)
    assert store.read("chunks").count() == store.read("embeddings").count() == 1
    index.clear(store)
    assert store.read("chunks").isEmpty()


def test_sync_of_people_panels_and_accounts(spark, tmp_path):
    from quillspan.operators import listing
    from quillspan.plans import sync
    from quillspan.sources.store import Store

    zone = tmp_path / "zone"

    def put(name, value):
        (zone / name).mkdir(parents=True, exist_ok=True)
        (zone / name / "r.json").write_text(json.dumps(value))

    person = lambda email, full: {"email": email, "details": {"person": {"name": {"fullName": full}}}}
    at = "2025-06-15T10:00:00Z"
    doc = {"id": "d1", "title": "T", "created_at": at, "updated_at": at, "notes_plain": "A paragraph that is long enough.", "people": {"creator": {"name": "Al", "email": "a@x"}, "attendees": [person("b@x", "Bob Full")]}, "google_calendar_event": {"id": "e"}}
    put("documents", {"docs": [doc, doc, {"id": "d2", "title": "U", "created_at": at, "updated_at": at}]})
    put("templates", [{"id": "t", "title": "t", "is_builtin": True, "sections": [{"title": "s"}]}])
    put("recipes", {"userRecipes": [{"id": "r", "config": {"model": "m"}}]})
    put("events", {"results": {"events": [{"id": "e", "attendees": [{"email": "b@x"}], "description": "why"}]}})
    put("utterances", [{"id": "u", "document_id": "d1", "text": "hello", "source": "system", "detected_speaker_name": "Bob"}])
    link = {"type": "text", "text": "chat", "marks": [{"type": "link", "attrs": {"href": "https://chat.example/t/1"}}]}
    put("panels", [{"id": "p", "document_id": "d1", "content": {"type": "doc", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "hi"}]}, {"type": "paragraph", "content": [link]}]}}])
    put("fetched", [{"document_id": "d1", "kind": "transcript"}, {"document_id": "d2", "kind": "transcript", "status": "not_found"}, {"document_id": "d1", "kind": "panels"}])
    store = Store(spark, str(tmp_path / "store"))
    store.write("people", spark.createDataFrame([("old",)], "id string"))
    got = sync.full_sync(store, str(zone), at, account="acc", chat_host="chat.example", embedder=(lambda: embed.byte_embedder(8), "bytes", 8))
    assert got["documents"] == {"inserted": 2, "updated": 0, "unchanged": 0} and got["index"]["failed"] == 0
    assert {(r["document_id"], r["full_name"], r["role"]) for r in store.read("document_people").collect()} == {("d1", "Al", "creator"), ("d1", "Bob Full", "attendee")}
    assert [r["id"] for r in listing.meetings_with(store.read("documents"), store.read("document_people"), "bob").collect()] == ["d1"]
    assert json.loads(store.read("documents").filter("id = 'd1'").first()["event_json"]) == {"id": "e"}
    t, r, e = (store.read(n).first() for n in ("templates", "recipes", "events"))
    assert t["is_builtin"] and json.loads(t["sections_json"]) == [{"title": "s"}] and json.loads(r["config_json"]) == {"model": "m"}
    assert json.loads(e["attendees_json"]) == [{"email": "b@x"}] and e["description"] == "why"
    p = store.read("panels").first()
    assert p["content_markdown"] == "hi" and p["chat_url"] == "https://chat.example/t/1" and json.loads(p["api_snapshot"])["content"] == "[stored]"
    u = store.read("utterances").first()
    assert json.loads(u["api_snapshot"])["text"] == "[stored]" and json.loads(u["api_snapshot"])["detected_speaker_name"] == "Bob" and u["text"] == "hello"
    assert store.read("people").first()["source_account_id"] == "acc" and [a["account_id"] for a in sync.accounts_seen(store).collect()] == ["acc"]
    assert [(x["document_id"], x["status"], x["attempts"]) for x in store.read("sync_log").collect()] == [("d2", "not_found", 1)]
    assert {(x["id"], x["kind"]) for x in sync.work_list(store).collect()} == {("d2", "panels")}
    put("utterances", [])  # d1's transcript comes back empty
    sync.full_sync(store, str(zone), at, account="later", only=["utterances"])
    assert store.read("utterances").isEmpty() and store.read("people").first()["source_account_id"] == "acc"


def test_repeated_keys_titles_and_copies(spark, tmp_path):
    stored = spark.createDataFrame([("a", "1", "x")], "id string, updated_at string, v string")
    incoming = spark.createDataFrame([("a", "2", "y"), ("a", "3", "z"), ("a", "3", "z"), ("b", None, "n"), (None, "9", "q")], stored.schema)
    assert {(r["id"], r["action"]) for r in ingest.classify(stored, incoming).collect()} == {("a", "updated"), ("b", "inserted")}
    assert {(r["id"], r["v"]) for r in ingest.upsert(stored, incoming).collect()} == {("a", "z"), ("b", "n")}
    results = spark.createDataFrame([(1, "d1", 1), (1, "d2", 2), (2, "d1", 1)], "query_id int, document_id string, rank int")
    labels = spark.createDataFrame([(1, "U", False), (2, "d1", True), (2, "d9", True)], "query_id int, label string, by_id boolean")
    documents = spark.createDataFrame([("d1", "d9"), ("d2", "U")], "id string, title string")  # a title that is another's id
    scores = {r["query_id"]: (r["best_rank"], r["found"], r["n_labels"]) for r in evaluation.query_scores(results, labels, documents=documents).collect()}
    assert scores == {1: (2, 1, 1), 2: (1, 1, 2)}
    for name in ("new", "same", "both"):
        stored.write.parquet(f"{tmp_path}/from/{name}")
    said = sinks.copy_tables(spark, ["new", "same", "both"], f"{tmp_path}/from", f"{tmp_path}/to", {"new": ("h", None, None), "same": ("h", "h", "h"), "both": ("h", "i", "j")})
    assert said == {"new": "proceed", "same": "up_to_date", "both": "diverged"} and [p.name for p in (tmp_path / "to").iterdir()] == ["new"]


def test_messages():
    from quillspan.plans import messages

    assert messages.command_line("grep", 'a "b"', limit=5, include_deleted=True, meeting=None) == "grep 'a \"b\"' --limit 5 --include-deleted"
    assert messages.grep_hint("q", 3, 3) is None and "3 meetings" in messages.grep_hint("q", 3, 1)
    assert messages.ambiguous_speaker("x", ["a", "b"]) and messages.freshness_warning("Fresh") is None


def test_standings_are_those_of_the_whole_ranking(spark):
    """Documents over several tasks and batches, relevant ones far behind the first k, ties, best chunks of one source left out."""
    rng = np.random.default_rng(5)
    rows = [(i, f"d{i // 4}", ("panel_section", "notes_paragraph")[i % 2], [float(x) for x in rng.integers(-2, 3, 3)], int(i // 4 % 23)) for i in range(400)]
    chunks = spark.createDataFrame(rows, "chunk_id long, document_id string, source_type string, vector array<double>, label int")
    queries = spark.createDataFrame([(i, [float(x) for x in rng.integers(-2, 3, 3)], i) for i in range(30)], "query_id long, q array<double>, label int")  # labels 23 to 29 have no document
    wanted = queries.join(chunks.select("document_id", "label").distinct(), "label").select("query_id", F.col("document_id").alias("label"))
    key = lambda df: sorted((r["query_id"], r["best_rank"], r["found"], r["n_labels"]) for r in df.select("query_id", F.col("best_rank").cast("long").alias("best_rank"), "found", "n_labels").collect())
    before = semantic.MOST_QUERIES, semantic.AT_ONCE
    try:
        semantic.MOST_QUERIES, semantic.AT_ONCE = 20, 100
        for without in ((), ("panel_section",)):
            best = semantic.best_chunks(semantic.scored(chunks, queries), 0.0)
            assert sorted(map(tuple, semantic.best_scored(chunks, queries).collect())) == sorted(map(tuple, best.select("query_id", "document_id", "chunk_id", "source_type", "score").collect()))
            results = semantic.ranked(best.filter(~F.col("source_type").isin(*without)) if without else best)
            want = key(evaluation.query_scores(results, wanted, 3))
            assert key(semantic.standings(chunks, queries, 3, without=without)) == want and max(r[1] or 0 for r in want) > 3
        plan = semantic.best_scored(chunks, queries)._jdf.queryExecution().toString()
        assert plan.index("MapInArrow") < plan.index("RepartitionByExpression") and "Aggregate" not in plan  # no score is shuffled
    finally:
        semantic.MOST_QUERIES, semantic.AT_ONCE = before


def test_children_are_replaced_without_a_table_of_all_parents(spark):
    rows = spark.range(2000).selectExpr("id div 4 as document_id", "id as line")
    parents = spark.range(0, 400, 2).selectExpr("id as document_id")
    out = ingest.replace_children(rows, rows.filter("line % 4 < 2"), parents.unionAll(parents))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") == 2 and "BroadcastExchange" not in plan
    assert {r["line"] for r in out.collect()} == {i for i in range(2000) if i % 4 < 2 or i // 4 >= 400 or i // 4 % 2}


def test_python_gets_few_rows_at_once(spark):
    """operators that send texts to Python bound the rows that a worker holds."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    panels = spark.createDataFrame([("p", "d", "## A\n\n" + "word " * 20, False)], "id string, document_id string, content_markdown string, deleted boolean")
    for run in (lambda: chunking.panel_chunks(panels), lambda: evidence.panel_sites(panels, "word")):
        spark.conf.set(name, 10_000)
        assert run().count() == 1 and int(spark.conf.get(name)) <= 500


def test_leading_documents_are_merged_in_parts():
    """places are held in narrow types and merged for some queries at once; the result is that of a whole sort."""
    rng = np.random.default_rng(5)
    score = np.round(rng.normal(size=(300, 4000)), 1)
    lead = semantic.Leading(4000, 7)
    assert sum(w.nbytes for w in [lead.score, *lead.what]) <= 4000 * 7 * 22
    for k in range(0, 300, 50):
        at = np.broadcast_to(np.arange(k, k + 50)[:, None], (50, 4000))
        lead.add(score[k : k + 50], at, at * 10, at % 3)
    want = np.argsort(-score, axis=0, kind="stable")[:7].T
    assert (lead.what[0] == want).all() and (lead.what[1] == want * 10).all() and (lead.what[2] == want % 3).all()


def test_index_drift_reads_each_side_once(spark):
    """F16: the plan makes the postings of the rows once; repeats count."""
    rows = spark.createDataFrame([("1", "1", "a b a"), ("2", "2", "b c")], "document_id string, row_id string, text string")
    index = search.postings(rows.filter("row_id = '1'")).unionAll(search.postings(rows.filter("row_id = '1'")).filter("term = 'a'"))
    drift = search.index_drift(index, rows)
    assert {r["kind"]: r["n"] for r in drift.collect()} == {"stale": 1, "missing": 2}
    plan = drift._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 3
