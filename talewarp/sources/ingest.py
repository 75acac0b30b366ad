"""Ingest requests: chunks of one source as canonical JSON with digests.

Null and empty optional fields are left out, field order is that of the structs below,
and no character is escaped that JSON doesn't demand, but for the two line separators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CHUNKS, MAX_BYTES = 500, 1 << 20
RECORD_DOMAIN, CHUNK_DOMAIN = "talewarp/record/v1", "talewarp/chunk/v1"
#: Formats of sources on the wire.
FORMATS = ["claude_code_jsonl", "codex_jsonl", "gemini_cli_json", "antigravity_transcript_or_protobuf", "chatgpt_export_json", "claude_app_export_json"]
_DIGEST = "^[0-9a-f]{64}$"


def canonical(value: Column) -> Column:
    """JSON of a struct without its null fields."""
    text = F.to_json(value)
    return F.replace(F.replace(text, F.lit(" "), F.lit("\\u2028")), F.lit(" "), F.lit("\\u2029"))


def _optional(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def source_struct(fmt: Column, volume: Column, obj: Column, path: Column, item: Column) -> Column:
    """The source key; numbers as 16 hexadecimal digits."""

    def digits(number: Column) -> Column:
        return F.lpad(F.lower(F.hex(number)), 16, "0")

    return F.struct(fmt.alias("format"), digits(volume).alias("root_volume"), digits(obj).alias("root_object"), path.alias("relative_path"), F.nullif(item, F.lit("")).alias("item_id"))


def cursor_error(cursor: Column) -> Column:
    """Why a cursor (kind and its fields, unused ones null) is invalid, or null."""
    lines = (cursor["start_exclusive"] >= 0) & (cursor["end_inclusive"] >= cursor["start_exclusive"]) & cursor["prefix_sha256"].rlike(_DIGEST) & cursor["revision_sha256"].isNull() & cursor["previous_revision_sha256"].isNull()
    previous = cursor["previous_revision_sha256"]
    revision = cursor["start_exclusive"].isNull() & cursor["end_inclusive"].isNull() & cursor["prefix_sha256"].isNull() & cursor["revision_sha256"].rlike(_DIGEST) & (previous.isNull() | (previous.rlike(_DIGEST) & (previous != cursor["revision_sha256"])))
    ok = F.when(cursor["kind"] == "physical_lines", lines).when(cursor["kind"] == "snapshot_revision", revision)
    return F.when(~F.coalesce(ok, F.lit(False)), "cursor")


def chunk_id(machine: Column, source: Column, kind: Column, session: Column, line: Column, ordinal: Column, content: Column, domain: str = CHUNK_DOMAIN) -> Column:
    """The identity of a chunk: a digest over its place and its text's digest."""
    identity = F.struct(F.lit(1).alias("schema_version"), machine.alias("machine_id"), source.alias("source"), kind.alias("chunk_type"), session.alias("session_id"), line.alias("source_line"), ordinal.alias("ordinal"), F.sha2(content, 256).alias("content_sha256"))
    return F.sha2(F.concat(F.lit(domain.encode() + b"\0"), canonical(identity).cast("binary")), 256)


def chunk_json(rows: DataFrame) -> Column:
    """A chunk of the table on the wire."""
    whole = F.date_format("Timestamp", "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.regexp_replace(F.date_format("Timestamp", ".SSSSSS"), r"\.?0+$", "")
    children = F.when(F.size("ChildChunkIds") > 0, F.col("ChildChunkIds"))
    fields = [F.col("Id").alias("id"), F.col("Content").alias("content"), F.col("ChunkType").alias("chunk_type"), F.col("SessionId").alias("session_id"), F.col("ProjectPath").alias("project_path"), F.col("ProjectName").alias("project_name"), F.concat(whole, fraction, F.lit("Z")).alias("timestamp")]
    fields += [_optional(c).alias(n) for c, n in (("UserUuid", "user_uuid"), ("AssistantUuid", "assistant_uuid"), ("FilePath", "file_path"), ("Operation", "operation"), ("Model", "model"))]
    fields += [F.col("SourceFile").alias("source_file"), F.col("SourceLine").alias("source_line"), _optional("ParentChunkId").alias("parent_chunk_id"), children.alias("child_chunk_ids")]
    return canonical(F.struct(*fields))


def encoded(rows: DataFrame, key: list[str], domain: str = RECORD_DOMAIN) -> DataFrame:
    """One request for each ``key``: body, digests, record id, and what is wrong with it.

    Rows are chunks with ``ordinal, machine_id, client_name, source, cursor, generation``.
    A request with more than ``MAX_CHUNKS`` chunks is reported and not built, so a group
    never gathers more.
    """
    sizes = rows.groupBy(*key).agg(
        F.count("*").alias("chunks"),
        (F.count("*") - F.count_distinct("Id")).alias("repeats"),
        (F.min("SourceFile") != F.max("SourceFile")).alias("mixed"),
        F.count_if(~F.col("Id").rlike(_DIGEST)).alias("bad_ids"),
    )
    fits = rows.join(sizes.where(F.col("chunks") <= MAX_CHUNKS).select(*key), key, "left_semi")
    texts = F.array_sort(F.collect_list(F.struct("ordinal", chunk_json(rows).alias("text"))))
    built = fits.groupBy(*key).agg(
        F.concat(F.lit("["), F.array_join(F.transform(texts, lambda x: x["text"]), ","), F.lit("]")).alias("payload"),
        F.first(F.struct("machine_id", _optional("client_name").alias("client_name"), "source", "cursor", "generation")).alias("head"),
    )
    head = canonical(F.struct(F.lit(1).alias("schema_version"), *(F.col(f"head.{n}").alias(n) for n in ("machine_id", "client_name", "source", "cursor", "generation"))))
    body = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"chunks":'), F.col("payload"), F.lit("}"))
    out = sizes.join(built, key, "left").withColumn("body", body)
    out = out.withColumn("request_sha256", F.sha2("body", 256)).withColumn("payload_sha256", F.sha2("payload", 256))
    record = F.sha2(F.concat(F.lit(domain.encode() + b"\0"), F.unhex("request_sha256")), 256)
    error = (
        F.when(F.col("chunks") > MAX_CHUNKS, "too_many_chunks")
        .when(F.col("repeats") > 0, "duplicate_chunk_id")
        .when(F.col("bad_ids") > 0, "chunk_id")
        .when(F.col("mixed"), "mixed_source_file")
        .when(~F.col("head.source.format").isin(FORMATS), "source_format")
        .when(cursor_error(F.col("head.cursor")).isNotNull(), "cursor")
        .when(F.octet_length("body") > MAX_BYTES, "request_too_large")
    )
    return out.select(*key, "chunks", "body", "request_sha256", "payload_sha256", record.alias("record_id"), error.alias("error"))
