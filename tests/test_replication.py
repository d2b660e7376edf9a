"""Copies of stored tables by content: what is sent, what stops them, and torn copies."""

import hashlib
from pathlib import Path

import pytest

from quillspan.sources import replication
from quillspan.sources.commits import Conflict
from quillspan.sources.files import opened
from quillspan.sources.ranges import RangeTable

SCHEMA = "id string, updated_at string, v string"


def rows_of(spark, pairs, at="1"):
    return spark.createDataFrame([(k, at, v) for k, v in pairs], SCHEMA)


def shown(table):
    return {r["id"]: r["v"] for r in table.read().collect()}


@pytest.fixture
def pair(spark, tmp_path):
    a, b = (RangeTable(spark, f"file://{tmp_path}/{n}", SCHEMA) for n in "ab")
    a.replace(rows_of(spark, [(str(i), "old") for i in range(200)]), bits=3)
    return a, b


def test_paths():
    assert opened("file:/a/b")[1] == opened("file:///a/b")[1] == opened("/a/b")[1] == "/a/b"


def test_hashes_are_those_of_whole_files_read_in_blocks(spark, tmp_path):
    (tmp_path / "f").mkdir()
    texts = {"x.bin": b"abcdef", "empty": b"", "even": b"12345678", "b=1 c%20": b"q" * 41}
    for name, text in texts.items():
        (tmp_path / "f" / name).write_bytes(text)
    got = {Path(r["path"]).name: r["hash"] for r in replication.file_hashes(replication.listed(spark, [f"file://{tmp_path}/f"]), 4).collect()}
    want = {n: hashlib.sha256(b"".join(hashlib.sha256(t[i : i + 4]).digest() for i in range(0, len(t), 4))).hexdigest() for n, t in texts.items() if t}
    assert got == want  # files without a byte are passed over
    assert replication.file_hashes(replication.listed(spark, [f"file://{tmp_path}/none"])).count() == 0


def test_a_changed_range_sends_one_file(spark, pair):
    a, b = pair
    assert replication.replicate(RangeTable(spark, f"{a.root}-none", SCHEMA), b)["decision"] == "up_to_date" and b.version() == -1
    first = replication.replicate(a, b)
    assert (first["decision"], first["files"]) == ("proceed", 8) and shown(b) == shown(a)
    assert replication.replicate(a, b)["decision"] == "up_to_date" and b.version() == 0
    a.upsert(rows_of(spark, [("7", "new")], "2"), "updated_at")
    assert replication.status(a, b)["files"] == 1
    second = replication.replicate(a, b)
    assert second["files"] == 1 and shown(b)["7"] == "new" and shown(b) == shown(a)
    assert [tuple(r) for r in b.changes(0).collect()] == [("7", "updated")]  # the feed goes along
    assert replication.damaged(b).count() == 0


def test_both_ways_and_both_changed(spark, pair):
    a, b = pair
    replication.replicate(a, b)
    b.upsert(rows_of(spark, [("8", "theirs")], "2"), "updated_at")
    back = replication.replicate(b, a)
    assert (back["decision"], back["files"]) == ("proceed", 1) and shown(a)["8"] == "theirs"
    a.upsert(rows_of(spark, [("1", "a")], "3"), "updated_at")
    b.upsert(rows_of(spark, [("2", "b")], "3"), "updated_at")
    n = b.version()
    assert replication.replicate(a, b)["decision"] == "diverged" and b.version() == n and shown(b)["2"] == "b"
    assert replication.replicate(a, b, force=True)["decision"] == "diverged" and shown(b) == shown(a) and shown(b)["2"] == "old"
    assert replication.status(b, a)["decision"] == "up_to_date"


def test_a_stranger_is_not_overwritten(spark, pair):
    a, b = pair
    b.replace(rows_of(spark, [("own", "x")]), bits=0)
    assert replication.replicate(a, b)["decision"] == "unknown" and shown(b) == {"own": "x"}


def test_what_a_torn_run_left_is_sent_again(spark, pair):
    a, b = pair
    files = [r["file"] for r in replication.tree(a).select("file").orderBy("file").collect()]
    root_a, root_b = (Path(opened(t.root)[1]) for t in (a, b))
    whole, half = (root_b / f for f in files[:2])
    for f, part in ((whole, 1.0), (half, 0.5)):
        f.parent.mkdir(parents=True, exist_ok=True)
        data = (root_a / f.relative_to(root_b)).read_bytes()
        f.write_bytes(data[: int(len(data) * part)])
    assert replication.replicate(a, b)["files"] == 7 and shown(b) == shown(a)  # all but the whole one


def test_damage_is_seen_and_mended(spark, pair):
    a, b = pair
    replication.replicate(a, b)
    files = [Path(opened(b.root)[1]) / r["file"] for r in replication.tree(b).orderBy("file").collect()]
    data = bytearray(files[0].read_bytes())
    data[10] ^= 1
    for f, text in ((files[0], bytes(data)), (files[1], files[1].read_bytes()[:-3])):
        f.write_bytes(text)
        crc = f.parent / f".{f.name}.crc"
        if crc.exists():
            crc.unlink()
    files[2].unlink()
    assert sorted(r["problem"] for r in replication.damaged(b).collect()) == ["content", "length", "missing"]


def test_a_commit_between_is_a_conflict(spark, pair, monkeypatch):
    a, b = pair
    send = replication._send

    def other(*args):
        b.replace(rows_of(spark, [("first", "x")]), bits=0)
        return send(*args)

    monkeypatch.setattr(replication, "_send", other)
    with pytest.raises(Conflict):
        replication.replicate(a, b)
    assert shown(b) == {"first": "x"}
