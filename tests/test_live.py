"""The live source against a local server that fails in each way."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from quillspan.plans import sync
from quillspan.sources import live
from quillspan.sources.store import Store

IDS = [f"d{i}" for i in range(12)]


def utterance(d):
    return {"id": f"u-{d}", "document_id": d, "text": f"said in {d}\nand more", "source": "system", "is_final": True, "start_timestamp": "2025-01-01T10:00:00Z", "end_timestamp": "2025-01-01T10:00:05Z"}


class Service(BaseHTTPRequestHandler):
    """d1 isn't known; d2 fails twice, then comes; d3 always fails; d4 is empty; d5 asks to slow down once; d6 isn't JSON."""

    seen = Counter()
    lock = threading.Lock()

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        d = body.get("document_id")
        with self.lock:
            self.seen[self.path, d] += 1
            n = self.seen[self.path, d]
        if self.headers.get("Authorization") != "Bearer t":
            return self.answer(401, "no")
        kind = self.path.split("/")[-1]
        if kind == "get-documents":
            docs = [{"id": i, "title": f"T {i}", "created_at": "2025-01-01T10:00:00Z", "updated_at": "2025-01-01T10:00:00Z"} for i in IDS]
            return self.answer(200, json.dumps({"docs": docs}, indent=1))
        if kind == "get-people":
            return self.answer(503, "down")
        if kind == "get-document-panels":
            return self.answer(200, json.dumps([{"id": f"p-{d}", "document_id": d, "title": "Notes", "created_at": "2025-01-01T10:00:00Z"}]))
        if d == "d1":
            return self.answer(404, "")
        if d == "d3" or d == "d2" and n <= 2:
            return self.answer(500, "oops")
        if d == "d5" and n == 1:
            return self.answer(429, "", {"Retry-After": "0"})
        self.answer(200, "[]" if d == "d4" else "<html>" if d == "d6" else json.dumps([utterance(d)], indent=2))

    def answer(self, code, text, headers=None):
        self.send_response(code)
        for k, v in (headers or {}).items():
            self.send_header(k, v)
        self.send_header("Content-Length", str(len(text.encode())))
        self.end_headers()
        self.wfile.write(text.encode())

    def log_message(self, *args):
        pass


@pytest.fixture
def url():
    Service.seen = Counter()
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()
    server.server_close()


OPTIONS = {"attempts": 3, "pause": 0.01, "documents": 5}
WANT = {"d1": ("not_found", 1), "d2": (None, 3), "d3": ("error", 3), "d4": ("not_found", 1), "d5": (None, 2), "d6": ("error", 1)}


def test_by_document(spark, tmp_path, url):
    queue = f"file://{tmp_path}/queue"
    ids = spark.createDataFrame([(i,) for i in [*IDS, "d1", None]], "document_id string")
    assert live.enqueue(spark, ids, queue) == 0
    rows = live.answers(spark, "transcript", url, "t", queue, **OPTIONS).collect()
    assert {r["document_id"]: (r["status"], r["attempts"]) for r in rows} == {i: WANT.get(i, (None, 1)) for i in IDS} and len(rows) == len(IDS)
    assert Service.seen["/v1/get-document-transcript", "d3"] == 3
    reader = live.ServiceReader({"kind": "transcript", "url": url, "queue": queue, "documents": "2"})
    assert sum(s.count for s in reader.partitions()) == 12 and max(s.count for s in reader.partitions()) == 2
    live.land(live.answers(spark, "transcript", url, "t", queue, **OPTIONS), f"file://{tmp_path}/land", "transcript")
    from quillspan.sources import landing

    got = {(r["id"], r["text"]) for r in landing.transcript(spark, f"file://{tmp_path}/land/utterances", lines=True).collect()}
    assert got == {(f"u-{d}", f"said in {d}\nand more") for d in IDS if WANT.get(d, (None,))[0] is None}
    assert landing.fetched(spark, f"file://{tmp_path}/land", "transcript", lines=True).filter("status is null").count() == 8


def test_an_empty_queue_and_wrong_options(spark, tmp_path, url):
    assert live.answers(spark, "panels", url, "t", f"file://{tmp_path}/none").count() == 0
    for kind, queue in (("else", None), ("panels", None)):
        with pytest.raises(Exception, match="kind is one of|name a queue"):
            live.answers(spark, kind, url, "t", queue).collect()
    with pytest.raises(Exception, match="401"):
        live.answers(spark, "documents", url, "wrong").collect()
    down = live.answers(spark, "documents", "http://127.0.0.1:9", "t", attempts=2, pause=0.01).collect()
    assert [(r["status"], r["attempts"]) for r in down] == [("error", 2)]


def test_pauses_grow_and_are_bounded():
    client = live.Client({"url": "http://x", "kind": "people", "pause": "1", "longest_pause": "6"})
    assert 0.5 <= client.wait(1, None) <= 1 and 2 <= client.wait(3, None) <= 4 and client.wait(9, None) <= 6
    assert client.wait(1, "4") == 4 and client.wait(1, "400") == 6 and client.wait(1, "Wed, 21 Oct") <= 1


def test_a_stream_takes_each_folder_once(spark, tmp_path, url):
    queue, out, check = (f"file://{tmp_path}/{n}" for n in ("queue", "out", "check"))
    batch = lambda ids: live.enqueue(spark, spark.createDataFrame([(i,) for i in ids], "document_id string"), queue)

    def run():
        q = live.answers(spark, "panels", url, "t", queue, stream=True, **OPTIONS).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).start()
        q.processAllAvailable()
        q.stop()
        return sorted(r["document_id"] for r in spark.read.parquet(out).collect())

    batch(["d0", "d1"])
    assert run() == ["d0", "d1"]
    batch(["d2"])
    batch(["d3"])
    assert run() == ["d0", "d1", "d2", "d3"]
    assert all(Service.seen["/v1/get-document-panels", d] == 1 for d in ("d0", "d1", "d2", "d3"))


def test_live_sync(spark, tmp_path, url):
    store = Store(spark, f"file://{tmp_path}/store")
    kinds = ["documents", "people", "transcript", "panels"]
    said = sync.live_sync(store, url, "t", f"file://{tmp_path}/run1", "2025-02-01T00:00:00Z", only=kinds, **OPTIONS)
    assert said["documents"]["inserted"] == 12 and "503" in said["people"]["error"], said
    assert "error" not in said["utterances"] and "error" not in said["panels"], said
    assert store.read("documents").count() == 12 and store.read("utterances").count() == 8 and store.read("panels").count() == 12
    log = {r["document_id"]: (r["status"], r["attempts"]) for r in store.read("sync_log").collect()}
    assert log == {"d1": ("not_found", 1), "d3": ("error", 1), "d4": ("not_found", 1), "d6": ("error", 1)}
    before = sum(Service.seen.values())
    sync.live_sync(store, url, "t", f"file://{tmp_path}/run2", "2025-02-02T00:00:00Z", only=kinds[2:], **OPTIONS)
    assert sum(Service.seen.values()) == before  # what failed is logged, the rest is there
    sync.live_sync(store, url, "t", f"file://{tmp_path}/run3", "2025-02-03T00:00:00Z", retry=True, only=kinds[2:3], **OPTIONS)
    assert {r["document_id"]: r["attempts"] for r in store.read("sync_log").collect()} == {"d1": 2, "d3": 2, "d4": 2, "d6": 2}
