"""Debounced streams, uploads and root reconciliation."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from talewarp.streaming.debounce import debounce
from talewarp.streaming.forward import ForwardIngest
from talewarp.streaming.upload import judge, upload
from talewarp.table import ChunkTable


def test_debounce_fires_once_a_path_is_quiet(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()

    def put(number, *rows):
        (tmp_path / "draft").write_text("\n".join(json.dumps({"path": p, "time": t}) for p, t in rows))
        os.rename(tmp_path / "draft", source / f"{number}.json")

    put(1, ("a", "2026-01-01T00:00:01Z"), ("a", "2026-01-01T00:00:03Z"), ("a", "2026-01-01T00:00:02Z"), ("b", None))
    events = spark.readStream.schema("path string, time timestamp").json(str(source))
    query = debounce(events, delay_ms=300).writeStream.format("memory").queryName("fired").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
    try:
        end = time.time() + 90
        while time.time() < end and spark.table("fired").count() < 2:
            time.sleep(0.3)
        put(2, ("a", "2026-01-01T00:00:09Z"))
        while time.time() < end and spark.table("fired").count() < 3:
            time.sleep(0.3)
    finally:
        query.stop()
    got = sorted((r["path"], str(r["time"])) for r in spark.table("fired").select("path", F.date_format("time", "ss").alias("time")).collect())
    assert got == [("a", "03"), ("a", "09"), ("b", "None")]


def test_uploads_are_judged(spark):
    def send(url, body, headers, timeout):
        key = headers["Idempotency-Key"]
        assert url == "https://host/base/v1/history/ingest" and headers["Authorization"] == "Bearer t"
        if key == "broken":
            raise ConnectionResetError("gone")
        if key in ("429", "503", "404"):
            return int(key), b""
        return 200, json.dumps({"record_id": "other" if key == "mixed" else key, "accepted": key != "refused"}).encode()

    keys = ["ok", "429", "503", "404", "mixed", "refused", "broken"]
    rows = spark.createDataFrame([(k, "d", "{}") for k in keys] + [("none", None, None), (None, "d", "{}")], "record_id string, request_sha256 string, body string")
    got = {r["record_id"]: (r["outcome"], r["code"]) for r in upload(rows, "https://host/base/", "t", send=send, connections=2).collect()}
    assert got == {"ok": ("done", 200), "429": ("retry", 429), "503": ("retry", 503), "404": ("failed", 404), "mixed": ("failed", 200), "refused": ("failed", 200), "broken": ("retry", None), "none": ("failed", None), None: ("failed", None)}
    assert judge(200, b"[", "x")[0] == "failed" and upload(rows.limit(0), "https://host", "t", send=send).count() == 0
    for endpoint, token in (("http://host", "t"), ("https://", "t"), ("https://host", "")):
        with pytest.raises(ValueError):
            upload(rows, endpoint, token)


def test_ticks_read_what_changed_in_batches(spark, tmp_path, monkeypatch):
    """More waiting files than a batch holds keep no other waiting; known files aren't read again."""
    from talewarp.streaming import forward

    monkeypatch.setattr(forward, "MAX_FILES", 2)
    root = tmp_path / "projects" / "-w-app"
    root.mkdir(parents=True)
    table = ChunkTable(spark, str(tmp_path / "t"), 16, buckets=2)
    table.initialize()
    ingest = ForwardIngest(spark, [str(tmp_path / "projects")], table, str(tmp_path / "state"))
    ingest.start()
    stamp = "2099-01-01T00:00:00Z"
    for i in range(3):
        (root / f"a{i}.jsonl").write_text("{bad\n")
    good = json.dumps({"type": "summary", "summary": "done", "sessionId": "s", "timestamp": stamp})
    (root / "z.jsonl").write_text(good)
    read, plain = [], ingest._snapshot
    ingest._snapshot = lambda names: read.append([os.path.basename(n) for n in names]) or plain(names)
    assert ingest.tick() == {"accepted": 1, "refused": 0, "waiting": 3} and table.read().count() == 1
    assert read == [["a0.jsonl", "a1.jsonl"], ["a2.jsonl", "z.jsonl"]]
    read.clear()
    assert ingest.tick() == {"accepted": 0, "refused": 0, "waiting": 0} and read == []
    os.utime(root / "z.jsonl")  # another time, the same content
    assert ingest.tick() == {"accepted": 0, "refused": 0, "waiting": 0} and read == [["z.jsonl"]]
    read.clear()
    (root / "a1.jsonl").write_text(good.replace("done", "mended"))
    # a file that changes while it is read is left to the next tick
    part = ingest._listed().where("path LIKE '%a1.jsonl'").collect()
    (root / "a1.jsonl").write_text(good.replace("done", "mended again"))
    assert ingest._batch(part, ingest._progress(), ingest.cutoff()) == {} and table.read().count() == 1
    read.clear()
    assert ingest.tick()["accepted"] == 1 and table.read().count() == 2 and read == [["a1.jsonl"]]


def test_roots_are_reconciled(spark, tmp_path):
    roots = [tmp_path / "one", tmp_path / "two"]
    for r in roots:
        r.mkdir()
    (roots[0] / "old.jsonl").write_text("{}\n")
    table = ChunkTable(spark, str(tmp_path / "t"), 16)
    table.initialize()

    def ingest(*names):
        return ForwardIngest(spark, [str(r) for r in names], table, str(tmp_path / "state"))

    first = ingest(roots[0])
    first.start()
    device = first._kept_roots()[str(roots[0])].split(":")[0]
    ingest(*roots).start()
    with pytest.raises(ValueError):
        ingest(roots[1]).start()
    # the device got another number
    both = ingest(*roots)
    inode = both._kept_roots()[str(roots[0])].split(":")[1]
    before = both._read("excluded").count()
    both._append("excluded", spark.createDataFrame([(None, "987654:5", None, "refused")], "path string, object string, session string, reason string"))
    both._keep_roots({str(roots[0]): f"987654:{inode}"})
    both.tick()
    assert both._kept_roots()[str(roots[0])] == f"{device}:{inode}"
    assert both._read("excluded").where(F.col("object") == f"{device}:5").count() == 1 and both._read("excluded").count() == before + 2
    # another folder took the root's place
    os.rename(roots[0], tmp_path / "away")
    roots[0].mkdir()
    with pytest.raises(ValueError):
        both.tick()
    os.rmdir(roots[0])
    with pytest.raises(FileNotFoundError):
        both.tick()
