import hashlib
import json
from datetime import UTC, datetime

from pyspark.sql import functions as F

from talewarp.schema import normalized
from talewarp.sources import ingest


def test_requests_are_canonical(spark):
    rows = [(hashlib.sha256(t.encode()).hexdigest(), t, i, g) for g, texts in (("a", ["one <&>", 'two "q"\n']), ("b", ["x"] * 2)) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "Id string, Content string, ordinal int, g string")
    values = {"ChunkType": "turn", "SessionId": "s", "ProjectPath": "/p", "ProjectName": "p", "SourceFile": "f"}
    frame = frame.select("*", *(F.lit(v).alias(k) for k, v in values.items()), F.lit(7).cast("long").alias("SourceLine"), F.lit(datetime(2026, 1, 2, 3, 4, 5, 120000, tzinfo=UTC)).alias("Timestamp"))
    cursor = F.struct(F.lit("physical_lines").alias("kind"), F.lit(0).alias("start_exclusive"), F.lit(9).alias("end_inclusive"), F.lit("0" * 64).alias("prefix_sha256"), *(F.lit(None).cast("string").alias(n) for n in ("previous_revision_sha256", "revision_sha256")))
    source = ingest.source_struct(F.lit("codex_jsonl"), F.lit(1), F.lit(255), F.lit("a/b.jsonl"), F.lit(""))
    chunks = normalized(frame).join(frame.select("Id", "ordinal", "g"), "Id").distinct()
    ready = frame.join(chunks.drop("g", "ordinal", *values, "Content", "SourceLine", "Timestamp").distinct(), "Id").select("*", F.lit("m").alias("machine_id"), F.lit("").alias("client_name"), source.alias("source"), cursor.alias("cursor"), F.lit(3).alias("generation"))
    got = {r["g"]: r for r in ingest.encoded(ready, ["g"]).collect()}
    body = json.loads(got["a"]["body"])
    assert list(body) == ["schema_version", "machine_id", "source", "cursor", "generation", "chunks"]
    assert body["source"] == {"format": "codex_jsonl", "root_volume": "0" * 15 + "1", "root_object": "0" * 14 + "ff", "relative_path": "a/b.jsonl"}
    assert [c["content"] for c in body["chunks"]] == ["one <&>", 'two "q"\n'] and body["chunks"][0]["timestamp"] == "2026-01-02T03:04:05.12Z"
    assert got["a"]["body"] == json.dumps(body, ensure_ascii=False, separators=(",", ":")) and got["a"]["error"] is None
    digest = hashlib.sha256(got["a"]["body"].encode()).digest()
    assert got["a"]["record_id"] == hashlib.sha256(b"talewarp/record/v1\0" + digest).hexdigest()
    assert got["b"]["error"] == "duplicate_chunk_id"
    ids = ready.select(ingest.chunk_id(F.col("machine_id"), F.col("source"), F.col("ChunkType"), F.col("SessionId"), F.col("SourceLine"), F.col("ordinal"), F.col("Content")).alias("i")).collect()
    assert len({r["i"] for r in ids}) == 4
