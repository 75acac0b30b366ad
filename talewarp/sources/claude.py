"""Coding-assistant transcripts in JSON lines, one entry per line (kind ``claude``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import basename, decoded_project, first_text, nanos, segment_after, stem, time_key, truncated
from . import common as c

RESULT_BYTES, NAME_BYTES, PROMPT_BYTES = 500, 100, 200


def session_of(path: Column) -> Column:
    """The folder before ``subagents``, else the file's stem."""
    parts = F.split(path, "/")
    at = F.array_position(parts, "subagents")
    before = F.when(at > 1, F.try_element_at(parts, (at - 1).cast("int")))
    return first_text(before, stem(path), F.lit("unknown"))


def entries(files: DataFrame) -> DataFrame:
    """Entries with their columns; ``reason`` is set where a line can't be used."""
    v = F.col("value")
    rows = c.json_lines(files).withColumn("type", c.text_at(v, "$.type")).withColumn("stamp", F.nullif(c.text_at(v, "$.timestamp"), F.lit(""))).withColumn("ns", nanos(F.col("stamp")))
    reason = (
        F.when(F.col("reason").isNotNull(), F.col("reason"))
        .when(~c.is_object(v), "entry_not_object")
        .when(F.coalesce(F.col("type"), F.lit("")) == "", "missing_type")
        .when(F.col("stamp").isNotNull() & F.col("ns").isNull(), "invalid_timestamp")
    )
    content = F.try_variant_get(v, "$.message.content", "variant")
    usable = F.when(F.col("type") == "user", (c.kind_of(content) == "STRING") | c.is_array(content)).when(F.col("type") == "assistant", c.is_array(content)).otherwise(content.isNotNull())
    has = F.coalesce(usable, F.lit(False))
    text = F.coalesce(c.text_at(v, "$.message.content"), F.array_join(F.array_compact(F.transform(c.items_at(v, "$.message.content"), rendered)), "\n"), F.lit(""))
    return c.settled(
        rows.withColumn("reason", reason),
        "path",
        "line",
        "reason",
        "type",
        "ns",
        F.coalesce(c.text_at(v, "$.summary"), F.lit("")).alias("summary"),
        first_text(c.text_at(v, "$.customTitle"), c.text_at(v, "$.agentName"), c.text_at(v, "$.title")).alias("title"),
        F.coalesce(c.text_at(v, "$.prUrl"), F.lit("")).alias("pr_url"),
        F.coalesce(c.number_or_text(v, "$.prNumber"), F.lit("")).alias("pr_number"),
        F.coalesce(c.text_at(v, "$.prRepository"), F.lit("")).alias("pr_repository"),
        c.text_at(v, "$.uuid").alias("uuid"),
        F.coalesce(c.text_at(v, "$.sessionId"), F.lit("")).alias("session"),
        (c.flag_at(v, "$.isCompactSummary") | (F.col("type") == "summary")).alias("is_summary"),
        F.when(has, text).otherwise("").alias("text"),
        F.when(has, c.text_at(v, "$.message.model")).alias("model"),
        F.when(has, F.array_compact(F.transform(F.filter(c.items_at(v, "$.message.content"), lambda b: c.text_at(b, "$.type") == "tool_use"), operation))).alias("ops"),
    )


def rendered(block: Column) -> Column:
    """A content block as text; null where it shows nothing."""
    kind, name = c.text_at(block, "$.type"), F.coalesce(c.text_at(block, "$.name"), F.lit(""))
    target = first_text(c.text_at(block, "$.input.file_path"), F.lit("unknown"))
    command = F.translate(truncated(F.coalesce(c.text_at(block, "$.input.command"), F.lit("")), NAME_BYTES), "\n\r", "  ")
    result = c.text_at(block, "$.content")
    return (
        F.when(kind == "text", F.coalesce(c.text_at(block, "$.text"), F.lit("")))
        .when((kind == "tool_use") & name.isin("Read", "Edit", "Write"), F.concat(F.lit("[Used "), name, F.lit(" on "), target, F.lit("]")))
        .when((kind == "tool_use") & (name == "Bash"), F.concat(F.lit("[Ran command: "), command, F.lit("]")))
        .when(kind == "tool_use", F.concat(F.lit("[Used "), name, F.lit("]")))
        .when((kind == "tool_result") & (F.octet_length(result) < RESULT_BYTES), F.concat(F.lit("[Result: "), result, F.lit("]")))
        .when(kind == "tool_result", F.lit("[Tool result truncated]"))
    )


def operation(block: Column) -> Column:
    """The write or edit that a tool call made; null for other tools."""
    name, old, new = c.text_at(block, "$.name"), c.text_at(block, "$.input.old_string"), c.text_at(block, "$.input.new_string")
    path = first_text(c.text_at(block, "$.input.file_path"), F.lit("unknown"))
    shown = F.concat(F.lit("Replaced '"), truncated(old, NAME_BYTES, "..."), F.lit("' with '"), truncated(new, NAME_BYTES, "..."), F.lit("'"))

    def made(kind: str, summary: Column) -> Column:
        return F.struct(path.alias("path"), F.lit(kind).alias("kind"), summary.alias("summary"), F.coalesce(c.text_at(block, "$.id"), F.lit("")).alias("id"))

    return F.when(name == "Write", made("write", F.lit("Created/overwrote file"))).when((name == "Edit") & old.isNotNull() & new.isNotNull(), made("edit", shown))


def _files(prompt: Column, project: Column) -> Column:
    ns = c.fallback_ns(F.col("ns"), F.col("line"))
    return F.transform(
        F.coalesce(F.col("ops"), F.array().cast("array<struct<path:string,kind:string,summary:string,id:string>>")),
        lambda op, i: F.struct(
            F.concat(F.lit("In project "), project, F.lit(", file "), op["path"], F.lit(" was "), op["kind"], F.lit(". "), op["summary"], F.lit(". This was in response to: "), prompt).alias("content"),
            op["path"].alias("path"),
            op["kind"].alias("kind"),
            F.concat(time_key(ns), op["path"], first_text(op["id"], F.concat(F.lit("idx"), i.cast("string")))).alias("key"),
            ns.alias("ns"),
            F.col("line").alias("line"),
            F.col("model").alias("model"),
            F.col("uuid").alias("assistant"),
        ),
    )


def chunks(files: DataFrame, machine: str = "") -> tuple[DataFrame, DataFrame]:
    """Chunks and issues of transcript files (``path, content``).

    Every entry gives one row at most: a summary, a title where the file has no summary, a
    link, an answer with the question before it, or the files of an answer without one.
    """
    parsed = entries(files)
    rows = c.carried_ns(parsed.where("reason IS NULL"))
    own, kind = session_of(F.col("path")), F.col("type")
    log = c.log_window("path")
    whole = log.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    named = ~F.col("is_summary") & kind.isin("custom-title", "agent-name")
    talks = ~F.col("is_summary") & kind.isin("user", "assistant")
    rows = rows.select(
        "*",
        F.first(F.when((F.col("session") != "") & (F.col("session") != own), F.col("session")), ignorenulls=True).over(whole).alias("other"),
        F.collect_list(F.when(~c.blank(F.col("title")), c.strip(F.col("title")))).over(whole).alias("every_title"),
        F.max("is_summary").over(whole).alias("summarized"),
        F.count(F.when(named, 1)).over(log.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("nth"),
        F.last(F.when(talks, F.struct("type", "text", "ns", "line", "session", "uuid")), ignorenulls=True).over(log.rowsBetween(Window.unboundedPreceding, -1)).alias("asked"),
    )
    pairs = (kind == "assistant") & talks & F.coalesce(F.col("asked.type") == "user", F.lit(False))
    project = decoded_project(segment_after(F.col("path"), "projects", last_ok=False))
    rows = rows.withColumn("project_path", project).select(
        "*",
        basename(F.col("project_path"), "/").alias("project_name"),
        F.array_join("every_title", " / ").alias("titles"),
        pairs.alias("pairs"),
        c.strip(F.col("asked.text")).alias("question"),
        c.strip(F.col("text")).alias("answer"),
        c.fallback_ns(F.col("ns"), F.col("line")).alias("at"),
        truncated(F.when(pairs, F.col("asked.text")), PROMPT_BYTES, "...").alias("prompt"),
    )
    rows = rows.withColumn("session", first_text(F.when(F.col("pairs"), F.col("asked.session")).otherwise(F.col("session")), F.col("other"), own))
    name = F.col("project_name")

    def summary(text: Column, title: Column) -> Column:
        body = c.strip(text)
        shown = F.when((title != "") & (title != body), F.concat(F.lit("Title: "), title, F.lit("\n"), body)).otherwise(body)
        return F.when(body != "", F.concat(F.lit("Session summary for "), name, F.lit(":\n"), shown))

    titled = named & (F.col("nth") == 1) & ~F.col("summarized") & (F.col("titles") != "")
    link = F.concat(
        F.lit("In project "),
        name,
        F.lit(", linked pull request"),
        F.when(F.col("pr_repository") != "", F.concat(F.lit(" in "), F.col("pr_repository"))).otherwise(""),
        F.when(F.col("pr_number") != "", F.concat(F.lit(" #"), F.col("pr_number"))).otherwise(""),
        F.when(F.col("pr_url") != "", F.concat(F.lit(": "), F.col("pr_url"))).otherwise(""),
    )
    question, answer, head = F.col("question"), F.col("answer"), F.concat(F.lit("In project "), name)
    said = (
        F.when((question != "") & (answer != ""), F.concat(head, F.lit(", user asked:\n"), question, F.lit("\n\nAssistant responded:\n"), answer))
        .when(question != "", F.concat(head, F.lit(", user asked:\n"), question, F.lit("\n\n[No assistant response]")))
        .when(answer != "", F.concat(head, F.lit(", assistant response:\n"), answer))
    )
    content = (
        F.when(F.col("is_summary"), summary(first_text(F.col("summary"), F.col("text")), first_text(F.col("title"), F.col("titles"))))
        .when(titled, summary(F.col("titles"), F.col("title")))
        .when((kind == "pr-link") & (F.concat("pr_url", "pr_number", "pr_repository") != ""), link)
        .when(F.col("pairs"), said)
    )
    lone = talks & (kind == "assistant") & ~F.col("pairs")
    pairs = F.col("pairs")
    turn_ns = F.when(pairs, F.coalesce(F.col("ns"), F.col("asked.ns"), F.col("at"))).otherwise(F.col("at"))
    made = F.when(pairs | lone, _files(F.coalesce(F.col("prompt"), F.lit("[unpaired assistant message]")), name))
    rows = rows.withColumn("content", content).withColumn("made", made)
    turns = rows.select(
        "path",
        "session",
        "project_path",
        "project_name",
        "content",
        F.when(F.col("is_summary") | named, "summary").otherwise("turn").alias("chunk_type"),
        turn_ns.alias("ns"),
        F.when(pairs, F.col("asked.line")).otherwise(F.col("line")).alias("line"),
        F.when(pairs, F.col("model")).alias("model"),
        F.when(pairs, F.col("asked.uuid")).alias("user"),
        F.when(pairs, F.col("uuid")).alias("assistant"),
        time_key(turn_ns).alias("key"),
        F.coalesce("made", F.array().cast(f"array<{c.FILE}>")).alias("files"),
    )
    return c.build_chunks(turns, machine), c.issues(parsed)
