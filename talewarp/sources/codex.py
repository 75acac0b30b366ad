"""Rollout logs in JSON lines, one event per line (kind ``codex``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.files import OPERATION, patch_operations, shell_operations
from ..functions.text import basename, first_text, go_json, nanos, rollout_session, time_key
from . import common as c

KNOWN = ["session_meta", "turn_context", "compacted", "event_msg", "response_item"]


def value_text(value: Column) -> Column:
    """A string as it is, other values as JSON; nothing for null."""
    return first_text(F.when(c.kind_of(value) == "STRING", F.try_variant_get(value, "$", "string")), F.when(c.kind_of(value) != "VOID", go_json(value)))


def message_text(payload: Column) -> Column:
    """The first text among message, text, summary and content; typed content parts by line."""
    parts = F.transform(
        F.filter(c.items_at(payload, "$.content"), lambda x: c.text_at(x, "$.type").isin("input_text", "output_text", "text") & (F.coalesce(c.text_at(x, "$.text"), F.lit("")) != "")),
        lambda x: c.text_at(x, "$.text"),
    )
    return first_text(*(c.text_at(payload, f"$.{k}") for k in ("message", "text", "summary", "content")), F.array_join(parts, "\n"))


def tool_summary(p: Column) -> Column:
    """One line for a tool event; empty for other events."""
    kind = c.text_at(p, "$.type")
    arguments = F.coalesce(c.part(p, "$.arguments"), c.part(p, "$.input"))
    items = F.filter(F.transform(c.items_at(p, "$.summary"), value_text), lambda x: x != "")
    return F.coalesce(
        F.when(kind.isin("function_call", "custom_tool_call"), c.strip(F.concat(F.lit("[Tool call] "), first_text(c.text_at(p, "$.name"), F.lit("unknown")), F.lit(" "), value_text(arguments))))
        .when(kind.isin("function_call_output", "custom_tool_call_output"), c.strip(F.concat(F.lit("[Tool output] "), value_text(F.try_variant_get(p, "$.output", "variant")))))
        .when(kind == "compacted", c.strip(F.concat(F.lit("[Compacted summary] "), message_text(p))))
        .when(kind == "web_search_call", c.strip(F.concat(F.lit("[Web search] "), F.coalesce(c.text_at(p, "$.action.query"), F.lit("")))))
        .when(kind == "reasoning", F.when(F.coalesce(F.size(items), F.lit(0)) > 0, F.concat(F.lit("[Reasoning summary] "), F.array_join(items, " "))).otherwise("[Reasoning summary]"))
        .when(kind == "ghost_snapshot", "[Ghost snapshot captured]"),
        F.lit(""),
    )


def tool_operations(p: Column) -> Column:
    """File operations of a tool call: of its patch, or of its shell command."""
    call = c.text_at(p, "$.type").isin("function_call", "custom_tool_call")
    name = c.text_at(p, "$.name")

    def patch_of(text: Column) -> Column:
        return c.bound(F.try_parse_json(text), lambda whole: F.when(c.is_object(whole), F.coalesce(c.text_at(whole, "$.patch"), F.lit(""))).when(text.contains("*** "), text))

    def of(arguments: Column) -> Column:
        written = F.try_parse_json(c.as_text(arguments))
        command = F.coalesce(c.text_at(arguments, "$.command"), c.text_at(written, "$.command"), F.lit(""))
        patched = c.bound(value_text(arguments), lambda text: F.when(text != "", patch_operations(patch_of(text))))
        return F.when(name.isin("apply_patch", "patch"), patched).when(name.isin("shell", "shell_command"), shell_operations(command))

    found = F.when(call, c.bound(F.coalesce(c.part(p, "$.arguments"), c.part(p, "$.input")), of))
    return F.coalesce(found, F.array().cast(f"array<{OPERATION}>"))


def events(files: DataFrame) -> DataFrame:
    v = F.col("value")
    rows = c.json_lines(files).withColumn("type", c.text_at(v, "$.type")).withColumn("stamp", F.nullif(c.text_at(v, "$.timestamp"), F.lit(""))).withColumn("ns", nanos(F.col("stamp")))
    reason = (
        F.when(F.col("reason").isNotNull(), F.col("reason"))
        .when(~c.is_object(v), "entry_not_object")
        .when(F.coalesce(F.col("type"), F.lit("")) == "", "missing_type")
        .when(F.col("stamp").isNotNull() & F.col("ns").isNull(), "invalid_timestamp")
    )
    payload = F.try_variant_get(v, "$.payload", "variant")
    return c.settled(rows.withColumn("reason", reason), "path", "line", "reason", "type", "ns", F.when(c.is_object(payload), payload).alias("payload"))


def chunks(files: DataFrame, machine: str = "") -> tuple[DataFrame, DataFrame]:
    """Chunks and issues of rollout logs (``path, content``).

    A user message opens a group; what follows until the next is its answer, under the
    project, model and session that hold at the group's last line.
    """
    parsed = events(files)
    p, kind = F.col("payload"), F.col("type")
    rows = c.carried_ns(parsed.where("reason IS NULL"))

    def meta(event: str, key: str) -> Column:
        return c.running(F.when(kind == event, c.text_at(p, f"$.{key}")), "path")

    rows = rows.select(
        "*",
        first_text(meta("session_meta", "id"), rollout_session(F.col("path")), F.lit("unknown")).alias("session"),
        first_text(meta("turn_context", "cwd"), meta("session_meta", "cwd"), F.lit("/unknown")).alias("project_path"),
        meta("turn_context", "model").alias("model"),
    )
    message = (kind == "response_item") & F.coalesce(c.text_at(p, "$.type").isin("message", "agent_message"), F.lit(False))
    rows = rows.withColumn("is_message", message).withColumn("said", F.when(message, c.strip(message_text(p))).when(kind == "response_item", tool_summary(p)))
    asks = F.col("is_message") & (F.col("said") != "") & F.coalesce(c.text_at(p, "$.role") == "user", F.lit(False))
    rows = rows.withColumn("asks", asks).withColumn("ops", F.when((kind == "response_item") & ~F.col("is_message"), tool_operations(p)).otherwise(F.array().cast(f"array<{OPERATION}>")))
    whole = c.log_window("path").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("turn_group", F.sum(F.col("asks").cast("int")).over(whole)).withColumn("at", c.fallback_ns(F.col("ns"), F.col("line")))
    rows = rows.withColumn("project_name", basename(F.col("project_path")))
    name = F.col("project_name")

    def told(verb: str, text: Column) -> Column:
        return F.concat(F.lit("In project "), name, F.lit(f", {verb}:\n"), text)

    own = F.coalesce(F.nullif(F.when(kind == "compacted", c.strip(message_text(p))), F.lit("")), F.when(kind == "event_msg", F.nullif(c.text_at(p, "$.message"), F.lit(""))), F.col("shown"), F.lit(""))
    as_event = F.concat(F.lit('{"payload":'), F.coalesce("shown", F.lit("null")), F.lit(',"type":'), c.json_text(kind), F.lit("}"))
    rows = rows.withColumn("shown", F.when(kind != "response_item", go_json(p))).withColumn("own", own).withColumn("as_event", F.when(~kind.isin(*KNOWN), as_event))
    own = F.col("own")
    at_once = (
        F.when((kind == "compacted") & (own != ""), told("assistant responded", F.concat(F.lit("[Compacted summary] "), own)))
        .when((kind == "event_msg") & ~c.blank(own), F.when(F.coalesce(c.text_at(p, "$.type") == "user_message", F.lit(False)), told("user said", own)).otherwise(told("assistant responded", own)))
        .when(F.col("as_event").isNotNull(), told("assistant responded", F.col("as_event")))
        .when((kind == "response_item") & (F.col("turn_group") == 0) & ~c.blank(F.col("said")), told("assistant responded", F.col("said")))
    )
    rows = rows.withColumn("at_once", at_once)
    loose = F.when((F.col("turn_group") == 0) & (kind == "response_item"), c.simple_files(F.col("ops"), name, F.col("at"), F.col("line")))
    now = F.when(F.col("at_once").isNotNull(), c.turn(F.col("at_once"), "turn", F.col("at"), files=F.coalesce(loose, F.array().cast(f"array<{c.FILE}>")), model=F.col("model")))
    # a line before the first question is a unit of its own, so no unit is larger than a question with its answer
    unit = F.when(F.col("turn_group") > 0, F.col("turn_group")).otherwise(-F.col("line"))
    units = (
        rows.withColumn("now", now)
        .groupBy("path", unit.alias("unit"))
        .agg(
            F.max_by(F.struct("session", "project_path", "project_name", "model"), "line").alias("state"),
            F.min_by(F.struct("said", "at", "line"), "line").alias("asked"),
            F.array_join(c.ordered(F.when((kind == "response_item") & ~F.col("asks") & (F.col("said") != ""), F.col("said"))), "\n").alias("answer"),
            F.flatten(c.ordered(F.col("ops"))).alias("ops"),
            c.ordered(F.col("now")).alias("now"),
        )
        .select("path", "unit", "state.*", "asked.*", c.strip(F.col("answer")).alias("answer"), "ops", "now")
    )
    content = F.concat(told("user asked", F.col("said")), F.lit("\n\nAssistant responded:\n"), F.col("answer"))
    whole_turn = c.turn(content, "turn", F.col("at"), files=c.simple_files(F.col("ops"), name, F.col("at"), F.col("line")), model=F.col("model"))
    turns = units.select("path", F.inline(F.concat(F.array_compact(F.array(F.when(F.col("unit") > 0, whole_turn))), F.col("now"))))
    return c.build_chunks(turns, machine), c.issues(parsed)
