"""Shared steps of the readers: files, JSON lines, carried times, and chunks from turns.

Every reader has the same shape and reads its log once: parse each line or message into
columns with VARIANT functions, order the log with windows over one file, which share one
exchange and sort, and hand rows with a text and its file operations to ``build_chunks``.
Only JSON that the built-in parser rejects, or that may be too deep, goes through a small
Arrow function.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.text import short_id, split_content, time_key
from ..schema import normalized

MAX_LINE_BYTES, MAX_DEPTH = 32 << 20, 50
MAX_SNAPSHOT_BYTES, MAX_FILES = 512 << 20, 1024
#: Largest files of line logs and of documents that are read.
MAX_LOG_BYTES, MAX_DOCUMENT_BYTES = 10 << 30, 2 << 30
#: Bytes of rows that go to Python at once.
BATCH_BYTES = 8 << 20
#: Splits of files whose numbers of lines are broadcast at most (about 200 bytes each).
FEW_SPLITS = 100_000
#: Fields of a file operation that ``build_chunks`` turns into a chunk.
FILE = "struct<content:string,path:string,kind:string,key:string,ns:bigint,line:bigint,model:string,assistant:string>"


def read_files(spark: SparkSession, path: str, glob: str = "*", most: int = MAX_SNAPSHOT_BYTES) -> DataFrame:
    """``path, content, digest, bytes, modified`` of the files below ``path``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).where(F.col("length") <= most)
    plain = F.regexp_replace("path", "^file:(?://)?(?=/)", "")
    return found.select(plain.alias("path"), "content", F.sha2("content", 256).alias("digest"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def read_lines(spark: SparkSession, path: str, glob: str = "*", most: int = MAX_LOG_BYTES) -> DataFrame:
    """``path, line, text`` of the physical lines below ``path``, numbered from 1 in each file.

    Files are read in splits by many tasks, from any store that Spark knows; a first pass
    counts the lines of every split without their texts, and sums over the splits before
    give each its first number. Files of more than ``most`` bytes are left out by their
    listing. Bytes that aren't UTF-8 become replacement characters; a carriage return at
    the end stays.
    """
    found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("lineSep", "\n").text(path)
    meta = F.col("_metadata")
    found = found.where(meta["file_size"] <= most).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("start"), F.col("value"), F.monotonically_increasing_id().alias("id"))
    splits = found.groupBy("file", "start").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(F.col("file").alias("of"), F.col("start").alias("at"), "first", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lines"))
    splits = F.broadcast(splits) if splits.limit(FEW_SPLITS + 1).count() <= FEW_SPLITS else splits
    within = F.col("id") - F.col("first")
    checked = F.when((within >= 0) & (within < F.col("n")), within).otherwise(F.raise_error(F.lit("a file changed while it was read")).cast("long"))
    plain = F.regexp_replace(F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B"))), "^file:(?://)?(?=/)", "")
    rows = found.join(splits, (F.col("file") == F.col("of")) & (F.col("start") == F.col("at")))
    return rows.select(plain.alias("path"), (F.col("lines") + checked + 1).alias("line"), F.make_valid_utf8("value").alias("text"))


def _depth(value: object) -> int:
    most, level = 0, [value]
    while level and most <= MAX_DEPTH + 1:
        level = [c for v in level if isinstance(v, dict | list) for c in (v.values() if isinstance(v, dict) else v)]
        most += bool(level)
    return most


@pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("depth", T.IntegerType())]))
def _reread(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """JSON text with the last of repeated keys, and how deep it is; null for what isn't JSON."""
    for batch in batches:
        rows = []
        for text in batch:
            try:
                value = json.loads(text) if text is not None else None
                rows.append((json.dumps(value), _depth(value)) if text is not None else (None, None))
            except (ValueError, RecursionError):
                rows.append((None, None))
        yield pd.DataFrame(rows, columns=["text", "depth"])


def _nested_deeper(text: Column, most: int) -> Column:
    """True if brackets of valid JSON stand in each other more than ``most`` times.

    Escapes go, then strings, then all but brackets; each turn takes away the innermost pairs.
    """
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?s)\\.", ""), r'"[^"]*"', ""), r"[^\[\]{}]+", "")
    left = F.aggregate(F.sequence(F.lit(1), F.lit(most)), F.translate(bare, "{}", "[]"), lambda x, _: F.replace(x, F.lit("[]"), F.lit("")))
    return left != ""


def small_batches(spark: SparkSession) -> None:
    """Python gets at most about ``BATCH_BYTES`` of rows at once, however long the texts; a setting of the user's stays."""
    name, own = "spark.sql.execution.arrow.maxBytesPerBatch", f"{64 << 20}b"
    if spark.conf.get(name, own) == own:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def parsed(rows: DataFrame, text: str) -> DataFrame:
    """``value`` (VARIANT) of a JSON column, and ``reason`` if it is invalid or too deep.

    Python reads again what the built-in parser rejects, and what is nested deeply.
    """
    small_batches(rows.sparkSession)
    first = rows.withColumn("_v", F.try_parse_json(F.col(text)))
    brackets = F.length(F.regexp_replace(F.col(text), r"[^\[{]", ""))
    deep = F.when(brackets > MAX_DEPTH, _nested_deeper(F.col(text), MAX_DEPTH)).otherwise(F.lit(False))
    again = first.withColumn("_r", _reread(F.when(F.col("_v").isNull() | deep, F.col(text))))
    value = F.coalesce("_v", F.try_parse_json("_r.text"))
    reason = F.when(F.col("_r.depth") > MAX_DEPTH, "json_too_deep").when(value.isNull(), "invalid_json")
    return again.withColumn("value", value).withColumn("reason", reason).drop("_v", "_r")


def json_lines(files: DataFrame) -> DataFrame:
    """``path, line, value, reason`` of each non-blank line; lines count from 1.

    ``files`` has whole files (``path, content``) or their lines (``read_lines``).
    """
    if "content" in files.columns:
        lines = files.select("path", F.posexplode(F.split(F.make_valid_utf8(F.col("content").cast("string")), "\n", -1)).alias("place", "text"))
        files = lines.select("path", (F.col("place") + 1).cast("long").alias("line"), "text")
    long_line = F.octet_length("text") > MAX_LINE_BYTES
    lines = files.select("path", "line", F.regexp_replace(F.when(~long_line, F.col("text")), r"^[\s]+|[\s]+$", "").alias("short")).where("short IS NULL OR short <> ''")
    out = parsed(lines, "short")
    return out.withColumn("reason", F.when(F.col("short").isNull(), "line_too_long").otherwise(F.col("reason"))).drop("short")


def settled(rows: DataFrame, *columns: Column | str) -> DataFrame:
    """``columns``, each computed once a row.

    A filter on a computed column is otherwise pushed below it, and takes a copy of its
    expression and of all that it is made of along; a generator keeps them apart.
    """
    return rows.select(F.inline(F.array(F.struct(*columns))))


def kind_of(value: Column) -> Column:
    return F.schema_of_variant(value)


def part(value: Column, path: str) -> Column:
    """A part of a variant, as a variant; null where it is missing or JSON null."""
    found = F.try_variant_get(value, path, "variant")
    return F.when(kind_of(found) != "VOID", found)


def text_at(value: Column, path: str) -> Column:
    """A part of a variant if it is a string; null otherwise."""
    return F.when(kind_of(F.try_variant_get(value, path, "variant")) == "STRING", F.try_variant_get(value, path, "string"))


def as_text(value: Column) -> Column:
    """A variant if it is a string; null otherwise."""
    return F.when(kind_of(value) == "STRING", F.try_variant_get(value, "$", "string"))


def json_text(text: Column) -> Column:
    """A text as a JSON string."""
    return bound(F.to_json(F.array(text)), lambda whole: F.substring(whole, F.lit(2), F.length(whole) - 2))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def flag_at(value: Column, path: str) -> Column:
    return F.coalesce(F.when(kind_of(F.try_variant_get(value, path, "variant")) == "BOOLEAN", F.try_variant_get(value, path, "boolean")), F.lit(False))


def number_or_text(value: Column, path: str) -> Column:
    """A string, or a number without decimals."""
    number = F.when(kind_of(F.try_variant_get(value, path, "variant")).rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.format_string("%.0f", F.try_variant_get(value, path, "double")))
    return F.coalesce(text_at(value, path), number)


def is_object(value: Column) -> Column:
    return F.coalesce(kind_of(value).startswith("OBJECT"), F.lit(False))


def is_array(value: Column) -> Column:
    return F.coalesce(kind_of(value).startswith("ARRAY"), F.lit(False))


def items_at(value: Column, path: str) -> Column:
    """The elements of an array in a variant; null if it isn't one."""
    return F.when(is_array(F.try_variant_get(value, path, "variant")), F.try_variant_get(value, path, "array<variant>"))


def blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\u0085 ]+|[\s\u0085 ]+$", "")


def log_window(*partition: str, order: str = "line"):
    return Window.partitionBy(*partition).orderBy(order)


def carried_ns(rows: DataFrame, ns: str = "ns", partition: tuple[str, ...] = ("path",), order: str = "line") -> DataFrame:
    """Times that are missing or within the first seconds become the last valid time before, else the first valid one."""
    w = log_window(*partition, order=order)
    valid = F.when(F.col(ns) >= 2_000_000_000, F.col(ns))
    before = F.last(valid, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    whole = F.first(valid, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn(ns, F.coalesce(before, whole, F.col(ns)))


def running(value: Column, *partition: str, order: str = "line") -> Column:
    """The last non-empty value up to a row."""
    w = log_window(*partition, order=order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.last(F.nullif(value, F.lit("")), ignorenulls=True).over(w)


def ordered(value: Column, order: str = "line") -> Column:
    """Aggregate: the non-null values of a group, in order."""
    rows = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(F.col(order), value.alias("_v")))))
    return F.transform(rows, lambda x: x["_v"])


def turn(content: Column, kind: str, ns: Column, line: Column | None = None, files: Column | None = None, **others: Column) -> Column:
    """A row for ``build_chunks`` as a struct; its session and project are the row's own unless given."""
    own = {"session": F.col("session"), "project_path": F.col("project_path"), "project_name": F.col("project_name")}
    empty = {name: F.lit(None).cast("string") for name in ("model", "user", "assistant")}
    return F.struct(
        content.alias("content"),
        F.lit(kind).alias("chunk_type"),
        ns.alias("ns"),
        (F.col("line") if line is None else line).cast("long").alias("line"),
        others.pop("key", time_key(ns)).alias("key"),
        (F.array().cast(f"array<{FILE}>") if files is None else files).alias("files"),
        *((others.get(name, value)).alias(name) for name, value in (own | empty).items()),
    )


def build_chunks(turns: DataFrame, machine: str = "") -> DataFrame:
    """Chunks of rows that have a text (null: none) and ``files``, an array of FILE.

    Long texts become parts with ids of their own; parts after the first name the whole
    text's id as parent. Files name the first part as parent, and it lists them as
    children. A row carries its chunks in an array that is exploded once, so the log is
    read once and linking needs no join.
    Columns: ``path`` and the fields of ``turn``.
    """
    session, key, first = F.col("session"), F.col("key"), F.col("pieces")
    many = F.size("pieces") > 1
    rows = turns.withColumn("pieces", F.coalesce(F.when(F.col("content").isNotNull(), split_content("content")), F.array().cast("array<string>")))
    shown = F.transform(first, lambda text, i: F.concat(F.lit("[Part "), (i + 1).cast("string"), F.lit("/"), F.size("pieces").cast("string"), F.lit("] "), text))
    rows = rows.withColumn("base", short_id(F.col("content"), session, key)).withColumn("texts", F.when(many, shown).otherwise(first)).drop("content")
    part_ids = F.transform("texts", lambda text, i: short_id(text, session, F.concat(key, F.lit("_part"), (i + 1).cast("string"))))
    rows = rows.withColumn("ids", F.when(many, part_ids).otherwise(F.array("base")))
    rows = rows.withColumn("children", F.transform("files", lambda f: short_id(f["content"], session, f["key"])))
    none = F.lit(None).cast("string")

    def chunk(**fields: Column) -> Column:
        return F.struct(*(value.alias(name) for name, value in fields.items()))

    said = F.transform(
        "texts",
        lambda text, i: chunk(
            Id=F.get("ids", i),
            Content=text,
            ChunkType=F.col("chunk_type"),
            TimestampNanos=F.col("ns"),
            UserUuid=F.col("user"),
            AssistantUuid=F.col("assistant"),
            FilePath=none,
            Operation=none,
            Model=F.col("model"),
            SourceLine=F.col("line"),
            ParentChunkId=F.when(i > 0, F.col("base")),
            ChildChunkIds=F.when((i == 0) & (F.size("files") > 0), F.col("children")),
        ),
    )
    touched = F.transform(
        "files",
        lambda f, i: chunk(
            Id=F.get("children", i),
            Content=f["content"],
            ChunkType=F.lit("file_change"),
            TimestampNanos=f["ns"],
            UserUuid=none,
            AssistantUuid=f["assistant"],
            FilePath=f["path"],
            Operation=f["kind"],
            Model=f["model"],
            SourceLine=f["line"],
            ParentChunkId=F.get("ids", F.lit(0)),
            ChildChunkIds=F.lit(None).cast("array<string>"),
        ),
    )
    shared = [session.alias("SessionId"), F.col("project_path").alias("ProjectPath"), F.col("project_name").alias("ProjectName"), F.col("path").alias("SourceFile")]
    out = rows.select(*shared, F.inline(F.concat(said, touched)))
    return normalized(out.withColumn("Timestamp", F.timestamp_micros(F.call_function("div", F.col("TimestampNanos"), F.lit(1000)))).withColumn("MachineId", F.nullif(F.lit(machine), F.lit(""))))


def simple_files(ops: Column, project: Column, ns: Column, line: Column) -> Column:
    """FILE rows of operations (path, kind, summary), numbered in order."""
    return F.transform(
        ops,
        lambda op, i: F.struct(
            F.concat(F.lit("In project "), project, F.lit(", file "), op["path"], F.lit(" was "), op["kind"], F.lit(".\nSummary: "), op["summary"]).alias("content"),
            op["path"].alias("path"),
            op["kind"].alias("kind"),
            F.concat(time_key(ns), op["path"], i.cast("string")).alias("key"),
            ns.alias("ns"),
            line.alias("line"),
            F.lit(None).cast("string").alias("model"),
            F.lit(None).cast("string").alias("assistant"),
        ),
    )


def fallback_ns(ns: Column, line: Column) -> Column:
    """A row without any time is as many microseconds after the epoch as its line."""
    return F.coalesce(ns, line * 1000)


def issues(rows: DataFrame) -> DataFrame:
    """``path, line, reason`` of what could not be used."""
    return rows.where("reason IS NOT NULL").select("path", "line", "reason")
