"""Step transcripts in JSON lines and binary histories (kind ``antigravity``).

Each event is a chunk of its own, so the reader is a map; titles and workspaces come
from a small SQLite table beside the transcripts, joined by session.
"""

from __future__ import annotations

import json
import os
import shutil
import sqlite3
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.files import OPERATION, PATCH_HEADERS, patch_operations
from ..functions.text import basename, first_text, go_json, nanos, segment_after, stem
from . import common as c

TITLE = "Antigravity Session"
SUMMARY_BYTES = 64 << 20
#: Where an event keeps its content, in order, and keys inside such objects.
CONTENT_KEYS = ["content", "text", "message", "user_input", "planner_response", "tool_response", "task_boundary", "generic", "system_message", "error_message", "error", "checkpoint", "summary", "output", "result", "task_name", "payload", "data"]
INNER_KEYS = ["content", "text", "message", "summary", "error", "output", "status"]
SHELL = r"\b(?:rm|touch)[\t\n\f\r ]+(?:-[^\t\n\f\r ]+[\t\n\f\r ]+)?([^\t\n\f\r ]+)"
SUMMARY_SCHEMA = "session string, title string, workspace string, workspace_name string"


def step_source(kind: Column) -> Column:
    upper = F.upper(kind)
    return F.when(upper == "USER_INPUT", "user").when(upper.isin("PLANNER_RESPONSE", "TASK_BOUNDARY"), "agent").when(upper == "TOOL_RESPONSE", "tool").when(upper.isin("GENERIC", "SYSTEM_MESSAGE", "CHECKPOINT", "ERROR_MESSAGE"), "system")


def session_of(path: Column) -> Column:
    return F.coalesce(segment_after(path, "brain"), stem(path))


@pandas_udf(T.ArrayType(T.StringType()))
def _quoted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Texts in double quotes with escapes, for summaries of replacements."""
    for batch in batches:
        yield batch.map(lambda xs: None if xs is None else [json.dumps(x, ensure_ascii=False) for x in xs])


def shell_operation(command: Column) -> Column:
    """The file that rm or touch names; a deletion if the text has rm anywhere."""
    deleted = command.contains("rm")
    op = F.struct(F.regexp_extract(command, SHELL, 1).alias("path"), F.when(deleted, "delete").otherwise("write").alias("kind"), F.when(deleted, "Deleted file").otherwise("Touched file").alias("summary"))
    return F.array_compact(F.array(F.when(command.rlike(SHELL), op)))


def parsed_call(call: Column) -> Column:
    """A tool call's id, name, arguments as JSON and as an object, and text that isn't an object."""

    def of(given: Column) -> Column:
        raw = c.as_text(given)
        return F.struct(
            c.text_at(call, "$.id").alias("id"),
            F.coalesce(c.text_at(call, "$.name"), F.lit("")).alias("name"),
            F.coalesce(go_json(given), F.lit("null")).alias("shown"),
            F.coalesce(F.when(c.is_object(given), given), F.try_parse_json(raw)).alias("args"),
            raw.alias("raw"),
        )

    return c.bound(F.coalesce(c.part(call, "$.args"), c.part(call, "$.arguments"), c.part(call, "$.input")), of)


def call_fields(call: Column) -> Column:
    """What operations need of a parsed call."""

    def first(*names: str) -> Column:
        return first_text(*(c.text_at(call["args"], f"$.{k}") for k in names))

    return F.struct(
        call["id"].alias("id"),
        call["name"].alias("name"),
        call["shown"].alias("shown"),
        F.when(call["raw"].isNotNull() & ~c.is_object(call["args"]), call["raw"]).alias("plain"),
        c.is_object(call["args"]).alias("is_object"),
        first("file_path", "path", "Path", "TargetFile", "AbsolutePath").alias("path"),
        first("old_string", "Target", "TargetContent").alias("old"),
        first("new_string", "Replacement", "ReplacementContent").alias("new"),
        first("command", "cmd", "CommandLine").alias("command"),
        c.text_at(call["args"], "$.patch").alias("patch"),
    )


def call_operations(call: Column, old: Column, new: Column) -> Column:
    """Operations of one tool call (``call_fields``); ``old`` and ``new`` are its texts in quotes."""
    name, path = call["name"], call["path"]
    changed = (old != '""') | (new != '""')
    kind = F.when(F.lower(name).contains("edit") | F.lower(name).contains("replace") | changed, "edit").otherwise("write")
    summary = F.when(changed, F.concat(name, F.lit(" tool call (replaced "), old, F.lit(" with "), new, F.lit(")"))).otherwise(F.concat(name, F.lit(" tool call")))
    own = F.array_compact(F.array(F.when(path != "", F.struct(path.alias("path"), kind.alias("kind"), summary.alias("summary")))))
    headers = PATCH_HEADERS[:3]
    plain = F.when(call["plain"].isNotNull(), F.concat(patch_operations(call["plain"], headers), shell_operation(call["plain"])))
    whole = F.when(call["is_object"], F.concat(own, patch_operations(call["patch"], headers), shell_operation(call["command"])))
    return F.coalesce(plain, whole, F.array().cast(f"array<{OPERATION}>"))


def said_in(v: Column) -> Column:
    """The first text under the content keys: as it is, or under the inner keys of an object."""

    def entries(value: Column) -> Column:
        return F.try_variant_get(value, "$", "map<string,variant>")

    def texts(value: Column) -> Column:
        inner = c.bound(entries(value), lambda m: F.transform(F.array(*map(F.lit, INNER_KEYS)), lambda k: c.as_text(F.try_element_at(m, k))))
        return F.concat(F.array(c.as_text(value)), F.coalesce(inner, F.array().cast("array<string>")))

    every = c.bound(entries(v), lambda m: F.flatten(F.transform(F.array(*map(F.lit, CONTENT_KEYS)), lambda k: c.bound(F.try_element_at(m, k), texts))))
    return F.coalesce(F.get(F.filter(every, lambda t: t != ""), F.lit(0)), F.lit(""))


def events(files: DataFrame) -> DataFrame:
    v = F.col("value")
    rows = c.json_lines(files).withColumn("stamp", F.nullif(first_text(c.text_at(v, "$.created_at"), c.text_at(v, "$.timestamp")), F.lit(""))).withColumn("ns", nanos(F.col("stamp")))
    reason = F.when(F.col("reason").isNotNull(), F.col("reason")).when(~c.is_object(v), "event_not_object").when(F.col("stamp").isNotNull() & F.col("ns").isNull(), "invalid_timestamp")
    kind = first_text(c.text_at(v, "$.type"), c.text_at(v, "$.step_type"))
    calls = F.concat(*(F.coalesce(F.filter(c.items_at(v, f"$.{k}"), c.is_object), F.array().cast("array<variant>")) for k in ("tool_calls", "toolCalls")))
    return c.settled(
        rows.withColumn("reason", reason),
        "path",
        "line",
        "reason",
        "ns",
        kind.alias("type"),
        first_text(c.text_at(v, "$.source"), c.text_at(v, "$.role"), step_source(kind), F.lit("unknown")).alias("source"),
        first_text(c.text_at(v, "$.status"), c.text_at(v, "$.task_status"), F.lit("unknown")).alias("status"),
        said_in(v).alias("said"),
        first_text(c.text_at(v, "$.thinking"), c.text_at(v, "$.thought")).alias("thinking"),
        first_text(c.number_or_text(v, "$.step_index"), F.lit("0")).alias("step"),
        F.transform(calls, parsed_call).alias("calls"),
    )


def summaries(rows: list[tuple[str, str, str]]) -> list[tuple[str, str | None, str | None, str | None]]:
    """Title and workspace of each session; of repeated sessions the first."""
    from urllib.parse import unquote, urlsplit

    out: dict[str, tuple[str, str | None, str | None, str | None]] = {}
    for session, title, uris in rows:
        if session in out:
            continue
        try:
            listed = json.loads(uris) if uris else []
            found = listed if isinstance(listed, list) and all(isinstance(x, str) for x in listed) else [uris]
        except ValueError:
            found = [uris]
        place = None
        for uri in found:
            parts = urlsplit(uri.strip())
            path = os.path.normpath(unquote(parts.path)) if parts.scheme == "file" and parts.path else ""
            if path not in ("", ".", "/"):
                place = path
                break
        out[session] = (session, title.strip() or None, place, os.path.basename(place) if place else None)
    return list(out.values())


def read_summaries(spark, database: str) -> DataFrame:
    """The side table ``conversation_summaries`` of a SQLite file, with its committed log.

    A file of at most ``SUMMARY_BYTES`` is copied and opened read-only; anything wrong
    gives an empty table, and readers fall back to defaults.
    """
    rows: list[tuple[str, str, str]] = []
    if os.path.isfile(database) and not os.path.islink(database) and os.path.getsize(database) <= SUMMARY_BYTES:
        with tempfile.TemporaryDirectory(prefix="talewarp-") as folder:
            copy = shutil.copy(database, f"{folder}/summaries.db")
            if os.path.isfile(f"{database}-wal"):
                shutil.copy(f"{database}-wal", f"{copy}-wal")
            try:
                with sqlite3.connect(copy) as connection:
                    table = connection.execute("SELECT * FROM conversation_summaries").fetchall()
                rows = [(r[0], *(x if isinstance(x, str) else "" for x in (r[1], r[5]))) for r in table if len(r) >= 6 and isinstance(r[0], str)]
            except sqlite3.Error:
                rows = []
    return spark.createDataFrame(summaries(rows), SUMMARY_SCHEMA)


def chunks(files: DataFrame, machine: str = "", sessions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Chunks and issues of transcripts (``path, content``); ``sessions`` as from ``read_summaries``."""
    parsed = events(files)
    rows = c.carried_ns(parsed.where("reason IS NULL")).withColumn("session", session_of(F.col("path")))
    if sessions is None:
        sessions = files.sparkSession.createDataFrame([], SUMMARY_SCHEMA)
    rows = rows.join(sessions, "session", "left")
    rows = rows.withColumn("calls", F.transform("calls", call_fields)).withColumn("at", c.fallback_ns(F.col("ns"), F.col("line")))
    rows = rows.withColumn("quoted", _quoted(F.flatten(F.transform("calls", lambda call: F.array(call["old"], call["new"])))))
    ops = F.flatten(F.transform("calls", lambda call, i: call_operations(call, F.get("quoted", 2 * i), F.get("quoted", 2 * i + 1))))
    shown = F.transform("calls", lambda x, i: F.concat(F.lit('{"ID":'), c.json_text(first_text(x["id"], (i + 1).cast("string"))), F.lit(',"Name":'), c.json_text(x["name"]), F.lit(',"Args":'), x["shown"], F.lit("}")))
    text = F.concat_ws(
        "\n\n",
        F.concat(F.lit("Source: "), "source"),
        F.concat(F.lit("Type: "), first_text(F.col("type"), F.lit("unknown"))),
        F.concat(F.lit("Status: "), "status"),
        F.when(F.col("said") != "", F.concat(F.lit("Content:\n"), "said")),
        F.when(F.col("thinking") != "", F.concat(F.lit("Thinking:\n"), "thinking")),
        F.when(F.size("calls") > 0, F.concat(F.lit("Tool calls:\n["), F.array_join(shown, ","), F.lit("]"))),
    )
    content = F.when(F.coalesce(F.col("title"), F.lit(TITLE)) != TITLE, F.concat(F.lit("Title: "), F.col("title"), F.lit("\n\n"), text)).otherwise(text)
    rows = rows.withColumn("ops", ops).withColumn("text", content)
    # of repeated (path, kind) the first counts
    keyed = F.transform("ops", lambda op: F.concat(op["path"], op["kind"]))
    rows = rows.withColumn("keys", keyed)
    first_ops = F.filter("ops", lambda op, i: F.array_position("keys", F.concat(op["path"], op["kind"])) == i + 1)
    made = F.transform(
        first_ops,
        lambda op: F.struct(
            F.concat(F.lit("In Antigravity session "), F.col("session"), F.lit(", file "), op["path"], F.lit(" was "), op["kind"], F.lit(".\nSummary: "), op["summary"]).alias("content"),
            op["path"].alias("path"),
            op["kind"].alias("kind"),
            F.concat(F.col("line").cast("string"), F.lit(":"), op["path"], op["kind"]).alias("key"),
            F.col("at").alias("ns"),
            F.col("line").alias("line"),
            F.lit(None).cast("string").alias("model"),
            F.lit(None).cast("string").alias("assistant"),
        ),
    )
    empty = F.lit(None).cast("string")
    turns = rows.withColumn("files", made).select(
        "path", "session", F.coalesce("workspace", F.concat(F.lit("/antigravity/"), F.col("session"))).alias("project_path"), F.coalesce("workspace_name", F.lit(TITLE)).alias("project_name"), F.col("text").alias("content"),
        F.lit("turn").alias("chunk_type"), F.col("at").alias("ns"), "line", F.lit("gemini-unknown").alias("model"), empty.alias("user"), empty.alias("assistant"), F.col("step").alias("key"), "files",
    )
    return c.build_chunks(turns, machine), c.issues(parsed)


def binary_chunks(files: DataFrame, machine: str = "") -> DataFrame:
    """A binary history as text, with control characters made spaces; nothing for one without text."""
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), r"[\x00-\x08\x0b-\x1f]+", " ")
    text = F.regexp_replace(text, "^ | $", "")
    rows = files.select("path", text.alias("text")).where(~c.blank(F.col("text")))
    empty = F.lit(None).cast("string")
    base = basename(F.col("path"))
    turns = rows.select(
        "path", stem(F.col("path")).alias("session"), F.lit("/antigravity/unknown").alias("project_path"), F.lit(TITLE).alias("project_name"), F.concat(F.lit("Google Antigravity History from "), base, F.lit("\n\n"), F.col("text")).alias("content"),
        F.lit("antigravity_history").alias("chunk_type"), F.lit(0).cast("long").alias("ns"), F.lit(0).cast("long").alias("line"), F.lit("gemini-unknown").alias("model"), empty.alias("user"), empty.alias("assistant"), F.lit("binary").alias("key"), F.array().cast(f"array<{c.FILE}>").alias("files"),
    )
    return c.build_chunks(turns, machine)
