"""Session documents and event logs as whole JSON files (kind ``gemini``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.files import OPERATION, patch_operations, shell_operations
from ..functions.text import first_text, go_json, nanos, segment_after, time_key
from . import common as c
from .codex import value_text


def tool_operations(calls: Column) -> Column:
    """Operations of patch and shell calls, in order."""

    def of(call: Column) -> Column:
        name = F.coalesce(c.text_at(call, "$.name"), F.lit(""))
        patches = F.concat(patch_operations(c.text_at(call, "$.args.patch")), patch_operations(c.text_at(call, "$.resultDisplay")))
        found = F.when(name.isin("apply_patch", "applyPatch", "patch"), patches).when(name.isin("shell", "shell_command", "bash"), shell_operations(F.coalesce(c.text_at(call, "$.args.command"), F.lit(""))))
        return F.coalesce(found, F.array().cast(f"array<{OPERATION}>"))

    return F.coalesce(F.flatten(F.transform(F.filter(calls, c.is_object), of)), F.array().cast(f"array<{OPERATION}>"))


def answer_text(v: Column) -> Column:
    """Content, thoughts and tool calls of a reply."""
    thoughts = F.array_join(F.transform(c.items_at(v, "$.thoughts"), value_text), "\n")
    calls = F.transform(
        F.filter(F.transform(c.items_at(v, "$.toolCalls"), lambda x, i: F.struct(x.alias("x"), (i + 1).cast("string").alias("n"))), lambda y: c.is_object(y["x"])),
        lambda y: F.concat(
            F.lit('{"args":'),
            F.coalesce(go_json(F.try_variant_get(y["x"], "$.args", "variant")), F.lit("null")),
            F.lit(',"id":'),
            _quoted(first_text(c.text_at(y["x"], "$.id"), y["n"])),
            F.lit(',"name":'),
            _quoted(F.coalesce(c.text_at(y["x"], "$.name"), F.lit(""))),
            F.lit(',"resultDisplay":'),
            _quoted(F.coalesce(c.text_at(y["x"], "$.resultDisplay"), F.lit(""))),
            F.lit("}"),
        ),
    )
    return F.concat_ws(
        "\n\n",
        F.nullif(value_text(F.try_variant_get(v, "$.content", "variant")), F.lit("")),
        F.when(F.size(c.items_at(v, "$.thoughts")) > 0, F.concat(F.lit("Thoughts:\n"), thoughts)),
        F.when(F.size(calls) > 0, F.concat(F.lit("Tool calls:\n"), F.array_join(calls, "\n"))),
    )


def _quoted(text: Column) -> Column:
    """A JSON string, escaped as in ``go_json``."""
    out = c.json_text(text)
    for char, code in (("<", "3c"), (">", "3e"), ("&", "26")):
        out = F.replace(out, F.lit(char), F.lit(f"\\u00{code}"))
    return out


def messages(files: DataFrame) -> DataFrame:
    """Rows of documents: events of an array, or messages of a session object."""
    docs = c.parsed(files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text")), "text")
    v = F.col("value")
    listed = c.is_array(v)
    items = F.when(listed, F.try_variant_get(v, "$", "array<variant>")).when(c.is_object(v), c.items_at(v, "$.messages"))
    wrong = F.when(F.col("reason").isNotNull(), F.col("reason")).when(~listed & ~c.is_object(v), "not_object_or_array").when(c.is_object(v) & (F.schema_of_variant(v).contains("messages")) & items.isNull() & F.try_variant_get(v, "$.messages", "variant").isNotNull(), "messages_not_array")
    bad = docs.select("path", F.lit(0).cast("long").alias("line"), wrong.alias("reason")).where("reason IS NOT NULL")
    rows = docs.where(F.col("reason").isNull()).select("path", listed.alias("is_event"), first_text(c.text_at(v, "$.sessionId"), F.lit("gemini-session")).alias("document_session"), F.posexplode(items).alias("place", "item"))
    item = F.col("item")
    reason = F.when(~c.is_object(item), F.when(F.col("is_event"), "event_not_object").otherwise("message_not_object"))
    rows = c.settled(
        rows,
        "path",
        (F.col("place") + 1).cast("long").alias("line"),
        reason.alias("reason"),
        "is_event",
        "document_session",
        "item",
        F.coalesce(c.text_at(item, "$.type"), F.lit("")).alias("type"),
        nanos(c.text_at(item, "$.timestamp")).alias("ns"),
    )
    return rows.unionByName(bad, allowMissingColumns=True)


def chunks(files: DataFrame, machine: str = "") -> tuple[DataFrame, DataFrame]:
    """Chunks and issues of documents (``path, content``)."""
    parsed = messages(files)
    rows = c.carried_ns(parsed.where("reason IS NULL"))
    item = F.col("item")
    segment = first_text(segment_after(F.col("path"), "tmp"), F.lit("unknown"))
    first_line = F.min("line").over(Window.partitionBy("path", "message_id"))
    rows = (
        rows.withColumn("project_name", segment)
        .withColumn("project_path", F.concat(F.lit("/gemini/"), segment))
        .withColumn("session", F.when(F.col("is_event"), first_text(c.text_at(item, "$.sessionId"), F.lit("gemini-logs"))).otherwise(F.col("document_session")))
        .withColumn("message_id", first_text(c.text_at(item, "$.id"), F.col("line").cast("string")))
        .withColumn("model", c.running(F.when(F.col("type") == "gemini", c.text_at(item, "$.model")), "path"))
        .withColumn("asks", ~F.col("is_event") & (F.col("type") == "user"))
        .withColumn("turn_group", F.sum(F.col("asks").cast("int")).over(c.log_window("path").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("first_line", first_line)
        .withColumn("replies", ~F.col("is_event") & (F.col("type") == "gemini"))
    )
    said = F.when(F.col("replies"), answer_text(item)).when(F.col("asks") | (~F.col("is_event") & (F.col("type") == "info")), value_text(F.try_variant_get(item, "$.content", "variant"))).otherwise(go_json(item))
    rows = rows.withColumn("said", said).withColumn("ops", F.when(F.col("replies"), tool_operations(c.items_at(item, "$.toolCalls"))).otherwise(F.array().cast(f"array<{OPERATION}>")))
    rows = rows.withColumn("at", c.fallback_ns(F.col("ns"), F.when(F.col("asks"), F.col("first_line")).otherwise(F.col("line"))))
    rows = rows.withColumn("model", F.when(~F.col("is_event"), F.col("model")))
    head = F.concat(F.lit("In project "), F.col("project_name"))
    files_of = c.simple_files(F.col("ops"), F.col("project_name"), F.col("at"), F.col("line"))
    alone = ~F.col("asks") & (~F.col("replies") | (F.col("turn_group") == 0)) & ~c.blank(F.col("said"))
    now = F.when(alone, c.turn(F.concat(head, F.lit(", assistant responded:\n"), F.col("said")), "turn", F.col("at"), files=files_of, model=F.col("model")))
    # an item before the first question is a unit of its own, so no unit is larger than a question with its answer
    unit = F.when(F.col("turn_group") > 0, F.col("turn_group")).otherwise(-F.col("line"))
    units = (
        rows.withColumn("now", now)
        .groupBy("path", unit.alias("unit"))
        .agg(
            F.max_by("model", "line").alias("model"),
            F.min_by(F.struct("session", "project_path", "project_name", "said", "at", F.col("first_line").alias("line")), "line").alias("asked"),
            F.array_join(c.ordered(F.when(F.col("replies") & (F.col("said") != ""), F.col("said"))), "\n").alias("answer"),
            F.flatten(c.ordered(F.col("ops"))).alias("ops"),
            c.ordered(F.col("now")).alias("now"),
        )
        .select("path", "unit", "model", "asked.*", c.strip(F.col("answer")).alias("answer"), "ops", "now")
    )
    content = F.concat(head, F.lit(", user asked:\n"), F.col("said"), F.lit("\n\nAssistant responded:\n"), F.col("answer"))
    whole_turn = c.turn(content, "turn", F.col("at"), files=files_of, model=F.col("model"))
    turns = units.select("path", F.inline(F.concat(F.array_compact(F.array(F.when(F.col("unit") > 0, whole_turn))), F.col("now"))))
    return c.build_chunks(turns, machine), c.issues(parsed)
