"""Readers on small files of each source's shape."""

import json
import random
import sqlite3

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from talewarp.sources import antigravity, claude, codex, common, exports, gemini


def files(spark, path, body):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(body if isinstance(body, str) else json.dumps(body))
    return common.read_files(spark, str(path.parent), path.name)


def lines(*rows):
    return "\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows)


def collected(pair):
    chunks, issues = pair
    return chunks.orderBy("SourceLine", "ChunkType").collect(), [tuple(r)[1:] for r in issues.orderBy("line").collect()]


def test_claude(spark, tmp_path):
    body = lines(
        {"type": "user", "uuid": "u1", "sessionId": "s1", "timestamp": "2026-01-02T03:04:05.120Z", "message": {"content": "please write"}},
        "{bad",
        {"type": "assistant", "uuid": "a1", "sessionId": "s1", "timestamp": "2026-01-02T03:04:06Z", "message": {"model": "m", "content": [{"type": "text", "text": "done"}, {"type": "tool_use", "id": "t", "name": "Write", "input": {"file_path": "/a/b.py"}}]}},
        {"type": "summary", "summary": "All good", "sessionId": "s1"},
        {"type": "assistant", "uuid": "a2", "message": {"content": [{"type": "tool_use", "name": "Edit", "input": {"file_path": "x", "old_string": "o" * 120, "new_string": "n"}}]}},
    )
    rows, issues = collected(claude.chunks(files(spark, tmp_path / "projects/-home-me-app/abc.jsonl", body), "mac"))
    assert issues == [(2, "invalid_json")]
    assert [(r["ChunkType"], r["SourceLine"]) for r in rows] == [("turn", 1), ("file_change", 3), ("summary", 4), ("file_change", 5)]
    turn, made, summary, lone = rows
    assert turn["Content"] == "In project app, user asked:\nplease write\n\nAssistant responded:\ndone\n[Used Write on /a/b.py]"
    assert turn["ChildChunkIds"] == [made["Id"]] and made["ParentChunkId"] == turn["Id"]
    assert (made["FilePath"], made["Operation"]) == ("/a/b.py", "write") and turn["ProjectPath"] == "/home/me/app"
    assert summary["Content"] == "Session summary for app:\nAll good"
    assert lone["ParentChunkId"] is None and "[unpaired assistant message]" in lone["Content"] and "..." in lone["Content"]


def test_claude_titles_links_and_parts(spark, tmp_path):
    stamp = "2026-01-02T03:04:05Z"
    body = lines(
        {"type": "custom-title", "customTitle": "First", "timestamp": stamp},
        {"type": "agent-name", "agentName": "Second", "timestamp": stamp},
        {"type": "pr-link", "prUrl": "u", "prNumber": 7, "prRepository": "r"},
        {"type": "user", "timestamp": stamp, "message": {"content": "one"}},
        {"type": "user", "timestamp": stamp, "message": {"content": "two"}},
        {"type": "assistant", "timestamp": stamp, "message": {"content": [{"type": "text", "text": "x. " * 5000}]}},
        {"type": "nothing", "timestamp": "yesterday"},
        {"a": 1, "a": 2, "type": "system"},
        "[1]",
    )
    rows, issues = collected(claude.chunks(files(spark, tmp_path / "projects/p/s.jsonl", body)))
    assert issues == [(7, "invalid_timestamp"), (9, "entry_not_object")]
    by = {r["SourceLine"]: r for r in rows if r["SourceLine"] < 5}
    assert by[1]["Content"] == "Session summary for p:\nTitle: First\nFirst / Second"
    assert by[3]["Content"] == "In project p, linked pull request in r #7: u"
    parts = [r for r in rows if r["SourceLine"] == 5]
    assert len(parts) == 3 and all("two" not in p["Content"] or p["Content"].startswith("[Part 1/3] ") for p in parts)
    assert sorted(p["ParentChunkId"] is None for p in parts) == [False, False, True]


def test_codex(spark, tmp_path):
    body = lines(
        {"type": "session_meta", "timestamp": "2026-01-02T03:00:00Z", "payload": {"id": "thread", "cwd": "/w/one"}},
        {"type": "turn_context", "payload": {"cwd": "/w/two", "model": "g"}},
        {"type": "response_item", "timestamp": "2026-01-02T03:00:01Z", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "fix it"}]}},
        "nope",
        {"type": "response_item", "payload": {"type": "function_call", "name": "apply_patch", "arguments": json.dumps({"patch": "*** Update File: q.py\n+a"})}},
        {"type": "response_item", "payload": {"type": "function_call", "name": "shell", "arguments": {"command": "touch z.txt"}}},
        {"type": "event_msg", "payload": {"message": "note"}},
        {"type": "odd"},
    )
    rows, issues = collected(codex.chunks(files(spark, tmp_path / "rollout-1.jsonl", body)))
    assert issues == [(4, "invalid_json")]
    turn = next(r for r in rows if r["ChunkType"] == "turn" and r["SourceLine"] == 3)
    made = [r for r in rows if r["ChunkType"] == "file_change"]
    assert sorted((r["FilePath"], r["Operation"]) for r in made) == [("q.py", "edit"), ("z.txt", "write")]
    assert sorted(turn["ChildChunkIds"]) == sorted(r["Id"] for r in made) and turn["SessionId"] == "thread" and turn["ProjectName"] == "two"
    assert any(r["Content"].endswith('{"payload":null,"type":"odd"}') for r in rows)


def test_gemini(spark, tmp_path):
    doc = {"sessionId": "g", "messages": [{"type": "info", "content": "hello", "timestamp": "2026-01-01T00:00:00Z"}, {"type": "odd", "x": 1}, {"type": "user", "content": "do"}, {"type": "gemini", "content": "ok", "model": "gm", "toolCalls": [{"name": "shell", "args": {"command": "rm a.txt"}}]}, 5]}
    rows, issues = collected(gemini.chunks(files(spark, tmp_path / "chats/session-1.json", doc)))
    assert issues == [(5, "message_not_object")]
    assert [r["ChunkType"] for r in rows] == ["turn", "turn", "file_change", "turn"]
    assert rows[3]["Model"] == "gm" and rows[2]["Operation"] == "delete" and rows[1]["Timestamp"] == rows[0]["Timestamp"]


def test_exports(spark, tmp_path):
    chat = [{"id": "c", "title": "T", "mapping": {"b": {"message": {"id": "m2", "author": {"role": "assistant"}, "create_time": 1700000001.5, "content": {"parts": ["hi", {"text": "x"}]}}}, "a": {"message": {"id": "m1", "author": {"role": "user"}, "create_time": 1700000000, "content": {"parts": ["q"]}}}}}, 3]
    rows, issues = collected(exports.chatgpt_chunks(files(spark, tmp_path / "a/conversations.json", chat)))
    assert [r["Content"] for r in rows] == ["In ChatGPT conversation T, user asked:\nq\n\nChatGPT responded:\nhi\nx"]
    assert issues == [(2, "conversation_not_object")] and rows[0]["SourceLine"] == 100002
    app = [{"uuid": "k", "name": "N", "postTurnSummary": "p", "chat_messages": [{"sender": "human", "text": "ask", "created_at": "2026-01-01T00:00:00Z"}, {"sender": "claude", "content": [{"text": "ans"}]}, {"sender": "assistant", "text": "lone", "lastTurnReport": {"text": "rep"}}]}]
    rows, issues = collected(exports.claudeapp_chunks(files(spark, tmp_path / "b/conversations.json", app)))
    assert [r["ChunkType"] for r in rows] == ["summary", "turn", "summary"] and not issues
    assert rows[2]["Content"] == "In Claude app conversation N:\nlone\n\nLast turn report:\nrep"


def test_antigravity(spark, tmp_path):
    database = tmp_path / "conversation_summaries.db"
    with sqlite3.connect(database) as connection:
        connection.execute("CREATE TABLE conversation_summaries (a, b, c, d, e, f)")
        connection.execute("INSERT INTO conversation_summaries VALUES ('s9', 'My title', 1, 2, 3, '[\"file:///w/my%20proj\"]')")
    body = lines(
        {"type": "USER_INPUT", "created_at": "2026-01-01T00:00:00Z", "step_index": 3, "content": "hey"},
        "bad",
        {"type": "PLANNER_RESPONSE", "planner_response": {"text": "plan"}, "tool_calls": [{"name": "edit_file", "args": {"file_path": "a.py", "old_string": 'x"y', "new_string": "z"}}, {"name": "run", "args": "touch k"}]},
    )
    sessions = antigravity.read_summaries(spark, str(database))
    rows, issues = collected(antigravity.chunks(files(spark, tmp_path / "brain/s9/transcript_full.jsonl", body), sessions=sessions))
    assert issues == [(2, "invalid_json")] and {r["ProjectPath"] for r in rows} == {"/w/my proj"}
    assert rows[0]["Content"] == "Title: My title\n\nSource: user\n\nType: USER_INPUT\n\nStatus: unknown\n\nContent:\nhey"
    assert [(r["FilePath"], r["Operation"]) for r in rows if r["ChunkType"] == "file_change"] == [("a.py", "edit"), ("k", "write")]
    assert antigravity.read_summaries(spark, str(tmp_path / "none.db")).count() == 0


def test_lines_are_numbered_across_splits(spark, tmp_path):
    rng = random.Random(1)
    bodies = {f"a b+%20/f{i}.jsonl": "".join(rng.choice(["", "x", "é" * 30, "y" * 200, "z\r"]) + "\n" for _ in range(n)) for i, n in enumerate([0, 1, 4000, 9000])}
    bodies["last.jsonl"] = "one\n\nlast line without an end"
    for name, body in bodies.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body.encode())
    (tmp_path / "bytes.jsonl").write_bytes(b"ok\n\xff\xfe\nend")
    (tmp_path / "large.jsonl").write_bytes(b"x\n" * 2_000_000)
    with_splits = spark.newSession()
    with_splits.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    found = common.read_lines(with_splits, str(tmp_path), "*.jsonl", 3_000_000)
    assert found.rdd.getNumPartitions() > 30
    got = sorted(tuple(r) for r in found.collect())
    want = [(f"{tmp_path}/{name}", i, line) for name, body in bodies.items() for i, line in enumerate(body.split("\n")[: -1 if body.endswith("\n") or not body else None], 1)]
    assert got == sorted(want + [(f"{tmp_path}/bytes.jsonl", i, t) for i, t in ((1, "ok"), (2, "\ufffd\ufffd"), (3, "end"))])


def test_readers_take_lines(spark, tmp_path):
    body = lines({"type": "user", "message": {"content": "q"}, "timestamp": "2026-01-02T03:04:05Z"}, "", {"type": "assistant", "message": {"content": [{"type": "text", "text": "a"}]}}, "{")
    whole = files(spark, tmp_path / "projects/p/s.jsonl", body)
    split = common.read_lines(spark, str(tmp_path / "projects/p"))
    assert collected(claude.chunks(split)) == collected(claude.chunks(whole)) != ([], [])


def test_plain_graphs_stay_out_of_python(spark, tmp_path, monkeypatch):
    """Python sees neither contents that are lists of texts, nor documents that have many brackets but aren't deep."""
    values = ["s", ["a", {"text": "b"}, ""], {"parts": ["a", {"text": "!"}]}, {"parts": []}, {"parts": ["a", ["b", {"value": "c"}]]}, {"text": "t"}, {"parts": [None, {"text": ""}, {"parts": ["x"], "text": "y"}]}, {"value": [1, "v"]}, None, 7, {"text": ["é\n", {"text": "\\\"]"}]}]
    for keys in (("parts", "text", "value", "content"), ("text", "content", "message", "value")):
        frame = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, j string").selectExpr("i", "parse_json(j) AS v")
        got = {r["i"]: r["t"][0] for r in frame.select("i", exports.nested_texts([F.col("v")], *keys).alias("t")).collect()}
        assert got == {i: exports._text_of(v, keys) for i, v in enumerate(values)}
    deep = lambda n: "[" * n + '"\\"[[{{"' + "]" * n
    texts = [deep(3), deep(common.MAX_DEPTH), deep(common.MAX_DEPTH + 1), "[" + ",".join(['{"a":["x\\\\","[["]}'] * 60) + "]", '{"a":' * 60 + "1" + "}" * 60]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[0] for r in frame.orderBy("i").select(common._nested_deeper(F.col("t"), common.MAX_DEPTH)).collect()] == [False, False, True, False, True]
    assert [r["reason"] for r in common.parsed(frame, "t").orderBy("i").collect()] == [None, None, "json_too_deep", None, "json_too_deep"]
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == f"{8 << 20}b"

    def refuse(given):
        raise AssertionError("a text went to Python")

    @pandas_udf("array<string>")
    def inner(batch: pd.Series) -> pd.Series:
        return batch.map(lambda ts: None if ts is None else refuse(ts))

    @pandas_udf("text string, depth int")
    def again(batch: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if t is None else refuse(t) for t in batch], columns=["text", "depth"])

    monkeypatch.setattr(exports, "_nested", lambda *keys: inner)
    monkeypatch.setattr(common, "_reread", again)
    mapping = {f"n{i}": {"message": {"author": {"role": "assistant" if i % 2 else "user"}, "create_time": i + 10, "content": {"parts": [f"t{i}", {"text": "!"}]}}} for i in range(40)}
    rows, issues = collected(exports.chatgpt_chunks(files(spark, tmp_path / "x/conversations.json", {"conversations": [{"conversation_id": "c", "mapping": mapping}]})))
    assert len(rows) == 20 and not issues and rows[0]["Content"].endswith("ChatGPT responded:\nt1\n!")
