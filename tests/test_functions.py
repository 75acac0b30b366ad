from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from talewarp.functions import files, text


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aé.\n 漢", max_size=400), st.integers(8, 60))
def test_split_bytes_covers_the_text(content, most):
    data = content.encode()
    parts = text.split_bytes(data, most, overlap=most // 4)
    assert all(len(p) <= most for p in parts)
    assert all(p.decode() is not None for p in parts)
    at = 0
    for part in parts:
        found = data.find(part, max(0, at - most))
        assert 0 <= found <= at
        at = max(at, found + len(part))
    assert at == len(data)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aé漢", max_size=200), st.integers(4, 40))
def test_plain_split_joins_back(content, most):
    parts = text.plain_split_bytes(content.encode(), most)
    assert b"".join(parts) == content.encode()
    assert all(len(p) <= most and p.decode() is not None for p in parts)


def test_text_columns(spark):
    row = spark.range(1).select(
        text.nanos(F.lit("2024-01-02T03:04:05.120Z")).alias("ns"),
        text.nanos(F.lit("2024-01-02")).alias("no_ns"),
        text.time_key(text.nanos(F.lit("2024-01-02T05:04:05.12+02:00"))).alias("key"),
        text.decoded_project(F.lit("-home-me-x")).alias("project"),
        text.decoded_project(F.lit("a..b")).alias("invalid"),
        text.basename(F.lit("/")).alias("base"),
        text.rollout_session(F.lit("/x/rollout-0A1b2c3d-0000-4000-8000-00000000abcd.jsonl")).alias("session"),
        F.octet_length(text.truncated(F.lit("aé" * 80), 101)).alias("cut"),
        text.go_json(F.parse_json(F.lit('{"b": 1.0, "a": "<x>&"}'))).alias("json"),
    ).first()
    assert row["ns"] == 1704164645120000000 and row["no_ns"] is None
    assert row["key"] == "2024-01-02 03:04:05.12+00:00"
    assert (row["project"], row["invalid"], row["base"]) == ("/home/me/x", "/invalid/path", "unknown")
    assert row["session"] == "0a1b2c3d-0000-4000-8000-00000000abcd"
    assert row["cut"] == 100 or row["cut"] == 101
    assert row["json"] == '{"a":"\\u003cx\\u003e\\u0026","b":1}'


def test_shell_and_patch(spark):
    cases = {"rm -f a/b": ("delete", "a/b"), "mv a b": ("move", "b"), "cp a b": ("write", "b"), "tee -a log": ("write", "log"), "sed -i s/a/b/ c.txt": ("edit", "c.txt"), "ls": None}
    rows = spark.createDataFrame([(k,) for k in cases], "c string").select("c", files.shell_operations(F.col("c")).alias("o")).collect()
    assert {r["c"]: (r["o"][0]["kind"], r["o"][0]["path"]) if r["o"] else None for r in rows} == cases
    patch = spark.range(1).select(files.patch_operations(F.lit("*** Add File: a\n context \n*** Delete File: b\n*** Move to: c")).alias("o")).first()["o"]
    assert [(x["kind"], x["path"]) for x in patch] == [("write", "a"), ("delete", "b"), ("move", "c")]


def test_routes(spark):
    cases = {
        "/h/claude-app/conversations.json": "claudeapp",
        "/h/conversations.json": "chatgpt",
        "/h/.gemini/antigravity/brain/x/transcript_full.jsonl": "antigravity",
        "/h/.gemini/antigravity/brain/x/other.jsonl": None,
        "/h/x.PB": "antigravity",
        "/h/.gemini/tmp/p/chats/session-1.json": "gemini",
        "/h/.gemini/tmp/p/other.json": None,
        "/h/logs.json": "gemini",
        "/h/.codex/sessions/a.jsonl": "codex",
        "/h/rollout-1.jsonl": "codex",
        "/h/projects/-a/b.jsonl": "claude",
        "/h/readme.md": None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "p string").select("p", files.source_kind(F.col("p")).alias("k")).collect()
    assert {r["p"]: r["k"] for r in rows} == cases


def test_debounced(spark):
    from talewarp.operators.logs import debounced

    events = spark.createDataFrame([("a", 1.0), ("a", 5.0), ("b", 2.0), ("c", 9.5)], "p string, s double").select("p", F.timestamp_seconds("s").alias("t"))
    rows = debounced(events, "p", "t", F.timestamp_seconds(F.lit(8)), 2.5).collect()
    assert [r["p"] for r in rows] == ["a", "b"] and rows[0]["t"].second == 5
