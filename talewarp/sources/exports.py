"""Chat exports: whole JSON files of conversations (kinds ``chatgpt`` and ``claudeapp``)."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.text import first_text, nanos, time_key
from . import common as c


def _text_of(value: object, keys: tuple[str, ...]) -> str:
    """Text in nested content: strings, lists of such joined by lines, or the first key with text."""
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        return "\n".join(t for t in (_text_of(v, keys) for v in value) if t)
    if isinstance(value, dict):
        if "parts" in keys and isinstance(value.get("parts"), list):
            return _text_of(value["parts"], keys)
        return next((t for k in keys if k != "parts" and (t := _text_of(value.get(k), keys))), "")
    return ""


def _nested(*keys: str):
    @pandas_udf(T.ArrayType(T.StringType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda ts: None if ts is None else [t and _text_of(json.loads(t), keys) for t in ts])

    return run


def _flat_text(value: Column, keys: tuple[str, ...]) -> Column:
    """``_text_of`` for a list, or the list of an object's parts, of strings and objects with a text; null for other shapes."""
    first, parts = next(k for k in keys if k != "parts"), F.try_variant_get(value, "$.parts", "array<variant>")
    items = F.when(c.is_array(value), F.try_variant_get(value, "$", "array<variant>"))
    if "parts" in keys:
        items = F.coalesce(items, F.when(c.is_array(F.try_variant_get(value, "$.parts", "variant")), parts))

    def one(item: Column) -> Column:
        held = F.nullif(c.text_at(item, f"$.{first}"), F.lit(""))
        if "parts" in keys:
            held = F.when(~c.is_array(F.try_variant_get(item, "$.parts", "variant")), held)
        return F.when(c.kind_of(item) == "STRING", F.try_variant_get(item, "$", "string")).when(c.is_object(item), held)

    return c.bound(F.transform(items, one), lambda t: F.when(~F.exists(t, lambda x: x.isNull()), F.array_join(F.filter(t, lambda x: x != ""), "\n")))


def nested_texts(values: list[Column], *keys: str) -> Column:
    """Texts of recursive contents as an array; strings and plain lists of texts don't leave the JVM."""
    plain = F.array(*(F.when(c.kind_of(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(_flat_text(v, keys)) for v in values))
    given = F.array(*(F.when((c.kind_of(v) != "STRING") & (c.kind_of(v) != "VOID") & _flat_text(v, keys).isNull(), F.to_json(v)) for v in values))
    inner = _nested(*keys)(F.when(F.exists(given, lambda t: t.isNotNull()), given))
    return F.array(*(F.coalesce(F.get(plain, F.lit(i)), F.get(inner, F.lit(i)), F.lit("")) for i in range(len(values))))


def _parts(value: Column, names: list[str]) -> list[Column]:
    return [F.try_variant_get(value, f"$.{n}", "variant") for n in names]


def _first_of(texts: Column, start: int, number: int) -> Column:
    """The first non-empty text of a stretch of an array."""
    return first_text(*(F.get(texts, F.lit(i)) for i in range(start, start + number)))


def conversations(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``path, place, item`` of each conversation (places count from 0), and issues of whole files."""
    docs = c.parsed(files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text")), "text")
    v = F.col("value")
    items = F.when(c.is_array(v), F.try_variant_get(v, "$", "array<variant>")).when(c.is_object(v), c.items_at(v, "$.conversations"))
    reason = F.coalesce(F.col("reason"), F.when(items.isNull(), "conversations_invalid"))
    bad = docs.select("path", F.lit(0).cast("long").alias("line"), reason.alias("reason")).where("reason IS NOT NULL")
    return docs.where(reason.isNull()).select("path", F.posexplode(items).alias("place", "item")), bad


def _seconds(value: Column, path: str) -> Column:
    """Nanoseconds of epoch seconds as a number, or of an RFC 3339 string."""
    number = F.when(c.kind_of(F.try_variant_get(value, path, "variant")).rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(value, path, "double"))
    whole = number.cast("long")
    return F.coalesce(whole * 1_000_000_000 + ((number - whole) * 1e9).cast("long"), nanos(c.text_at(value, path)))


def chatgpt_chunks(files: DataFrame, machine: str = "") -> tuple[DataFrame, DataFrame]:
    """Strict pairs of user and assistant (or tool) messages of each conversation."""
    found, bad = conversations(files)
    item = F.col("item")
    bad = bad.unionByName(found.where(~c.is_object(item)).select("path", (F.col("place") + 1).cast("long").alias("line"), F.lit("conversation_not_object").alias("reason")))
    found = found.where(c.is_object(item)).select(
        "path",
        "place",
        first_text(c.text_at(item, "$.id"), c.text_at(item, "$.conversation_id"), (F.col("place") + 1).cast("string")).alias("id"),
        first_text(c.text_at(item, "$.title"), F.lit("Untitled")).alias("title"),
        c.items_at(item, "$.messages").alias("messages"),
        F.when(c.is_object(F.try_variant_get(item, "$.mapping", "variant")), F.try_variant_get(item, "$.mapping", "map<string,variant>")).alias("mapping"),
    )
    missing = found.where("messages IS NULL AND mapping IS NULL").select("path", (F.col("place") + 1).cast("long").alias("line"), F.lit("messages_missing").alias("reason"))
    listed = F.transform("messages", lambda m, i: F.struct((i + 1).cast("string").alias("node"), m.alias("entry"), m.alias("m")))
    graph = F.transform(F.map_entries("mapping"), lambda e: F.struct(e["key"].alias("node"), e["value"].alias("entry"), F.try_variant_get(e["value"], "$.message", "variant").alias("m")))
    every = found.select("path", "place", "id", "title", F.col("messages").isNotNull().alias("listed"), F.posexplode(F.coalesce(listed, graph)).alias("n", "x")).select("path", "place", "id", "title", "listed", "n", "x.*")
    wrong = every.where(~c.is_object(F.col("entry"))).select("path", (F.col("place") + 1).cast("long").alias("line"), F.when(F.col("listed"), "message_not_object").otherwise("node_not_object").alias("reason"))
    m = F.col("m")
    role = F.lower(first_text(c.text_at(m, "$.author.role"), c.text_at(m, "$.role"), c.text_at(m, "$.sender")))
    every = every.where(c.is_object(m)).select(
        "path",
        "place",
        "id",
        "title",
        "node",
        "listed",
        "n",
        role.alias("role"),
        nested_texts(_parts(m, ["content", "text", "message"]), "parts", "text", "value", "content").alias("texts"),
        F.coalesce(*(_seconds(m, f"$.{k}") for k in ("create_time", "created_at", "update_time"))).alias("ns"),
        first_text(c.text_at(m, "$.id"), c.text_at(m, "$.message_id"), F.col("node")).alias("uuid"),
    )
    # messages of a list stand in their order, those of a graph by time
    log = Window.partitionBy("path", "place").orderBy(F.when(F.col("listed"), F.col("n")), F.col("ns").isNull(), "ns", "node")
    every = every.withColumn("text", _first_of(F.col("texts"), 0, 3)).withColumn("n", F.row_number().over(log))
    talks = ~c.blank(F.col("text")) & F.col("role").isin("user", "assistant", "tool")
    log = Window.partitionBy("path", "place").orderBy("n")
    pairs = every.where(talks).withColumn("asked", F.lag(F.struct("role", "text", "uuid")).over(log)).where("role <> 'user' AND asked.role = 'user'")
    pairs = pairs.withColumn("line", (F.col("place") + 1).cast("long") * 100_000 + F.col("n")).withColumn("at", c.fallback_ns(F.col("ns"), F.col("line")))
    content = F.concat(F.lit("In ChatGPT conversation "), F.col("title"), F.lit(", user asked:\n"), F.col("asked.text"), F.lit("\n\nChatGPT responded:\n"), F.col("text"))
    turn = c.turn(content, "turn", F.col("at"), session=F.col("id"), project_path=F.lit("/chatgpt/export"), project_name=F.lit("ChatGPT"), user=F.col("asked.uuid"), assistant=F.col("uuid"))
    return c.build_chunks(pairs.select("path", turn.alias("t")).select("path", "t.*"), machine), bad.unionByName(missing).unionByName(wrong)


#: Headings of the notes of a conversation or message, and the names that they go by.
NOTES = [("Post-turn summary:\n", "postTurnSummary", "post_turn_summary"), ("Last turn report:\n", "lastTurnReport", "last_turn_report"), ("Side session notes:\n", "sideSessionNotes", "side_session_notes")]
TEXTS = ["text", "content", "message"]


def _notes(texts: Column, start: int) -> Column:
    """The three kinds of notes with their headings, from an array that has their texts from ``start`` on."""
    return F.concat_ws("\n\n", *(F.concat(F.lit(heading), F.nullif(_first_of(texts, start + 2 * i, 2), F.lit(""))) for i, (heading, *_) in enumerate(NOTES)))


def claudeapp_chunks(files: DataFrame, machine: str = "") -> tuple[DataFrame, DataFrame]:
    """Conversation notes as summaries, pairs of user and assistant, and lone messages with notes.

    A conversation with notes goes before its messages as a row of its own, so that all
    are read at once.
    """
    found, bad = conversations(files)
    item, m = F.col("item"), F.col("m")
    line_of = (F.col("place") + 1).cast("long")
    bad = bad.unionByName(found.where(~c.is_object(item)).select("path", line_of.alias("line"), F.lit("conversation_not_object").alias("reason")))
    found = found.where(c.is_object(item)).select(
        "path",
        "place",
        first_text(c.text_at(item, "$.uuid"), c.text_at(item, "$.id"), c.text_at(item, "$.conversation_id"), line_of.cast("string")).alias("id"),
        first_text(c.text_at(item, "$.name"), c.text_at(item, "$.title"), F.lit("Untitled")).alias("title"),
        F.concat(F.array(item), F.coalesce(c.items_at(item, "$.chat_messages"), c.items_at(item, "$.messages"), F.array().cast("array<variant>"))).alias("messages"),
    )
    rows = found.select("path", "place", "id", "title", F.posexplode("messages").alias("j", "m"))
    wrong = rows.where((F.col("j") > 0) & ~c.is_object(m)).select("path", line_of.alias("line"), F.lit("message_not_object").alias("reason"))
    speaker = F.coalesce(c.part(m, "$.sender"), c.part(m, "$.role"), c.part(m, "$.author"))
    named = F.coalesce(F.when(c.kind_of(speaker) == "STRING", F.try_variant_get(speaker, "$", "string")), c.text_at(speaker, "$.role"), c.text_at(speaker, "$.name"), F.lit(""))
    rows = rows.where(c.is_object(m)).select(
        "path",
        "place",
        "id",
        "title",
        (F.col("j") == 0).alias("heads"),
        F.sum(F.lit(1)).over(Window.partitionBy("path", "place").orderBy("j")).alias("n"),
        F.lower(named).alias("role"),
        nested_texts(_parts(m, TEXTS + [n for _, *names in NOTES for n in names]), "text", "content", "message", "value").alias("texts"),
        nanos(first_text(c.text_at(m, "$.created_at"), c.text_at(m, "$.createdAt"), c.text_at(m, "$.timestamp"))).alias("ns"),
        first_text(c.text_at(m, "$.uuid"), c.text_at(m, "$.id"), c.text_at(m, "$.message_id"), F.col("j").cast("string")).alias("uuid"),
    )
    rows = rows.select(
        "path",
        "place",
        "id",
        "title",
        "heads",
        (F.col("n") - 1).alias("n"),
        F.when(F.col("role") == "human", "user").when(F.col("role") == "claude", "assistant").otherwise(F.col("role")).alias("role"),
        F.when(~F.col("heads"), F.nullif(_first_of(F.col("texts"), 0, 3), F.lit(""))).alias("own"),
        F.nullif(_notes(F.col("texts"), 3), F.lit("")).alias("extra"),
        F.when(~F.col("heads"), F.col("ns")).alias("ns"),
        "uuid",
    )
    log = Window.partitionBy("path", "place").orderBy("n")
    whole = log.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = log.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("text", F.concat_ws("\n\n", "own", "extra"))
    talks = (F.col("text") != "") & ~F.col("heads") & F.col("role").isin("user", "assistant")
    rows = rows.withColumn("first_ns", F.first(F.when(F.col("ns") >= 2_000_000_000, F.col("ns")), ignorenulls=True).over(whole)).withColumn("asked", F.last(F.when(talks, F.struct("role", "text", "uuid", "ns")), ignorenulls=True).over(before))
    rows = rows.withColumn("line", line_of * 100_000 + F.col("n"))
    heads, role, at = F.col("heads"), F.col("role"), F.coalesce(F.col("ns"), F.col("first_ns"), F.col("line") * 1000)
    asked = F.coalesce(F.col("asked.role") == "user", F.lit(False))
    pairs = ~heads & (role == "assistant") & (F.col("text") != "") & asked
    lone = ~heads & ((role == "assistant") & ~asked | ~role.isin("user", "assistant")) & F.col("extra").isNotNull()
    title = F.concat(F.lit("In Claude app conversation "), F.col("title"))
    content = (
        F.when(heads, F.concat(F.lit("Session summary for Claude app conversation "), F.col("title"), F.lit(":\n"), F.col("extra")))
        .when(pairs, F.concat(title, F.lit(", user asked:\n"), F.col("asked.text"), F.lit("\n\nClaude responded:\n"), F.col("text")))
        .when(lone, F.concat(title, F.lit(":\n"), F.col("text")))
    )
    rows = rows.withColumn("content", content).withColumn("pairs", pairs)
    ns = F.when(F.col("pairs"), F.coalesce(F.col("ns"), F.col("asked.ns"), at)).otherwise(at)
    turns = rows.select(
        "path",
        F.col("id").alias("session"),
        F.lit("/claude-app/export").alias("project_path"),
        F.lit("Claude App").alias("project_name"),
        "content",
        F.when(F.col("pairs"), "turn").otherwise("summary").alias("chunk_type"),
        ns.alias("ns"),
        "line",
        F.lit(None).cast("string").alias("model"),
        F.when(F.col("pairs"), F.col("asked.uuid")).alias("user"),
        F.when(~heads, F.col("uuid")).alias("assistant"),
        time_key(ns).alias("key"),
        F.array().cast(f"array<{c.FILE}>").alias("files"),
    )
    return c.build_chunks(turns, machine), bad.unionByName(wrong)
