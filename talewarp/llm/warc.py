"""WARC archives in Zstandard frames (op 2): writer, and reader with validation.

An archive is a sequence of Zstandard frames. The first is a skippable frame that holds
the dictionary (itself compressed); each following frame is one whole WARC record,
compressed with that dictionary, so any record can be decoded alone. An empty skippable
frame, which every decoder passes over, follows each.

Writing: equal payloads are found by an aggregate over (digest, id), pre-aggregated
before the shuffle, so a payload shared by a third of all pages costs one row a task.
Pages then meet their record type; revisits are broadcast while they are few, so that
html isn't shuffled. Tasks encode records, and Spark's text writer puts the frames into
files of about ``archive_bytes`` in the shared folder, on any store that Spark writes
and with its commit protocol: a text row is written as its bytes are, and the separator
between rows is the empty skippable frame. Files are named as Spark names them.

Reading: Spark reads the files as binary; each task decodes frame by frame and checks
magic, dictionary, version line, mandatory headers, Content-Length, the end of record,
and the payload digest. Archives made elsewhere may hold other record types; their
headers, lengths and digests (SHA-256 in hexadecimal, SHA-1 in base 32) are checked and
their block is the payload.

The dictionary is trained on a bounded sample: ``DICT_SAMPLES`` pages with the smallest
id hashes, ``DICT_SAMPLE_BYTES`` of each. It only affects size.

Defined results: null html is an empty payload; a null url gives an empty target;
payloads under ``MIN_REVISIT`` bytes are always responses; rows that repeat the
response's page id are responses too; null ids come back as null, as a revisit if
another page has the same payload; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, by_bytes, checkpointed, fresh_folder, joined, map_batches, small_or_not

MIN_REVISIT, ARCHIVE_BYTES, LEVEL = 100, 32 << 20, 3
DICT_BYTES, DICT_SAMPLES, DICT_SAMPLE_BYTES = 64 << 10, 512, 8 << 10
DATE = "2024-01-01T00:00:00Z"
#: Revisits up to which they are broadcast (about 200 bytes each), and html that a task encodes at once.
FEW_ROWS, SLICE_BYTES = 250_000, 4 << 20
#: Fixed values of the Zstandard and WARC formats.
SKIPPABLE_DICT = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
EMPTY_FRAME = "P*M\x18\0\0\0\0"  # magic number 0x184D2A50, length 0
PLAIN_TYPES = ("warcinfo", "request", "metadata", "resource", "conversion", "continuation")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """An archive that breaks the format."""


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary, or nothing where there are too few samples to train one."""
    samples = [s for s in samples if s]
    if len(samples) < 8 or sum(map(len, samples)) < 8 * DICT_BYTES // 4:
        return b""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def dictionary_frame(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=10).compress(dictionary)
    return struct.pack("<II", SKIPPABLE_DICT, len(packed)) + packed


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit keeps the HTTP head and omits the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{_record_uuid(page_id)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_one_line(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:uuid:{_record_uuid(refers_to)}>", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _record_uuid(page_id: int | None) -> uuid.UUID:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}")


def _one_line(text: str | None) -> str:
    return " ".join((text or "").split())


def _headers(raw: bytes, what: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in raw.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"{what}: bad header line {line[:60]!r}")
        if (key := name.decode("ascii").lower()) in out:
            raise WarcError(f"{what}: header {key} is repeated")
        out[key] = value.decode("utf-8").strip()
    return out


def _length(headers: dict[str, str], what: str) -> int:
    value = headers.get("content-length", "")
    if not value.isascii() or not value.isdigit():
        raise WarcError(f"{what}: bad content-length {value!r}")
    return int(value)


def _check_digest(stated: str | None, data: bytes) -> None:
    """Raise where a digest is stated that ``data`` doesn't have."""
    algorithm, _, digest = (stated or "").partition(":")
    found = {"sha256": lambda: hashlib.sha256(data).hexdigest(), "sha1": lambda: base64.b32encode(hashlib.sha1(data).digest()).decode()}.get(algorithm)
    if stated and (found is None or found() != digest):
        raise WarcError(f"{stated[:80]!r} is not the digest of {len(data)} bytes")


def parse_record(raw: bytes) -> dict:
    """Fields of one record; raises WarcError where a header, length or digest is wrong."""
    head, blank, rest = raw.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not blank or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError(f"no WARC record: {raw[:40]!r}")
    headers = _headers(lines, "record")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if not headers.get(name):
            raise WarcError(f"record without {name}")
    size = _length(headers, "record")
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise WarcError(f"record of {len(rest)} bytes after its head, {size + 4} announced")
    kind = headers["warc-type"]
    if kind in PLAIN_TYPES:
        _check_digest(headers.get("warc-block-digest"), rest[:size])
        return {
            "page_id": None,
            "url": headers.get("warc-target-uri"),
            "payload": rest[:size],
            "payload_bytes": size,
            "payload_digest": hashlib.sha256(rest[:size]).hexdigest(),
            "record_type": kind,
            "refers_to": None,
        }
    http, blank, payload = rest[:size].partition(b"\r\n\r\n")
    status, _, lines = http.partition(b"\r\n")
    if not blank or not status.startswith(b"HTTP/1."):
        raise WarcError("block is not an HTTP response")
    announced = _length(_headers(lines, "block"), "block")
    _, _, digest = headers.get("warc-payload-digest", "").partition(":")
    if kind == "response":
        if len(payload) != announced:
            raise WarcError(f"payload of {len(payload)} bytes, {announced} announced")
        _check_digest(headers.get("warc-payload-digest"), payload)
        digest = hashlib.sha256(payload).hexdigest()
    elif kind == "revisit":
        if payload or headers.get("warc-profile") != REVISIT_PROFILE or "warc-refers-to" not in headers:
            raise WarcError("bad revisit record")
    else:
        raise WarcError(f"unknown record type {kind!r}")
    page, refers = headers.get("x-page-id"), headers.get("x-refers-to-page-id")
    return {
        "page_id": int(page) if page else None,
        "url": headers.get("warc-target-uri"),
        "payload": payload,
        "payload_bytes": announced,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": int(refers) if refers else None,
    }


def read_archive(data: bytes) -> Iterator[dict]:
    """The records of one archive, a frame at a time."""
    view, at, dictionary = memoryview(data).cast("B"), 0, None
    decoder = zstandard.ZstdDecompressor()
    while at < len(view):
        magic = int.from_bytes(view[at : at + 4], "little")
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            size = int.from_bytes(view[at + 4 : at + 8], "little")
            if at + 8 + size > len(view):
                raise WarcError("skippable frame runs beyond the archive")
            if magic == SKIPPABLE_DICT and at == 0:
                held = bytes(view[8 : 8 + size])
                try:
                    dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(held) if held.startswith(FRAME_MAGIC) else held)
                except zstandard.ZstdError as error:
                    raise WarcError(f"bad dictionary: {error}") from error
                decoder = zstandard.ZstdDecompressor(dict_data=dictionary)
            at += 8 + size
            continue
        if view[at : at + 4] != FRAME_MAGIC:
            raise WarcError(f"no frame at byte {at}")
        one = decoder.decompressobj()
        parts, start = [], at
        try:
            while not one.eof and at < len(view):
                step = view[at : at + (1 << 20)]
                parts.append(one.decompress(step))
                at += len(step)
        except zstandard.ZstdError as error:
            raise WarcError(f"bad frame at byte {start}: {error}") from error
        if not one.eof:
            raise WarcError(f"frame at byte {start} is cut off")
        at -= len(one.unused_data)
        yield parse_record(b"".join(parts))


def record_types(pages: DataFrame) -> DataFrame:
    """``page_id, digest, first`` for pages that revisit another's payload of at least ``MIN_REVISIT`` bytes."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", payload.alias("payload")).where(F.length("payload") >= MIN_REVISIT).select("page_id", F.sha2("payload", 256).alias("digest"))
    keyed = checkpointed(keyed)
    firsts = checkpointed(keyed.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL"))
    return checkpointed(joined(keyed, firsts, "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).distinct())


def write(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write the archives into the new ``folder``."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    hashed = pages.where("html IS NOT NULL").withColumn("h", F.xxhash64("page_id"))
    least = hashed.select("h").orderBy("h").limit(DICT_SAMPLES).agg(F.max("h")).first()[0]
    samples = hashed.where(F.col("h") <= F.lit(least)).select(F.substring("html", 1, DICT_SAMPLE_BYTES).alias("t")).limit(DICT_SAMPLES).collect() if least is not None else []
    dictionary = train_dictionary([r["t"].encode()[:DICT_SAMPLE_BYTES] for r in samples])
    # records of a file, by the size of an average page; its first row is the dictionary
    size = pages.agg(F.avg(F.octet_length("html"))).first()[0] or 0
    rows = max(2, int(archive_bytes / (size + 400)) + 1)
    types = small_or_not(record_types(pages).select(F.col("page_id").alias("revisit_id"), F.col("digest").alias("revisit_digest"), "first"), FEW_ROWS)
    digest = F.sha2(F.coalesce(F.col("html"), F.lit("")).cast("binary"), 256)
    same = F.col("page_id").eqNullSafe(F.col("revisit_id")) & (F.col("digest") == F.col("revisit_digest"))
    typed = pages.withColumn("digest", digest).join(types, same, "left").select("page_id", "url", "html", "digest", "first", F.col("revisit_digest").isNotNull().alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=held) if held else zstandard.ZstdCompressor(level=LEVEL)
        number = 0
        for batch in batches:
            for part in by_bytes(batch, "html", SLICE_BYTES):
                frames = []
                for page, url, payload, digest, first, revisit in zip(*(part.column(c).to_pylist() for c in ("page_id", "url")), as_bytes(part.column("html")), *(part.column(c).to_pylist() for c in ("digest", "first", "revisit")), strict=True):
                    if dictionary and number % rows == 0:
                        frames.append(dictionary_frame(dictionary))
                        number += 1
                    frames.append(coder.compress(record(page, url, payload, digest, first, revisit)))
                    number += 1
                yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["frame"])

    frames = map_batches(typed, run, "frame binary").select(F.col("frame").cast("string").alias("frame"))
    frames.write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", rows).text(folder)


def read(spark: SparkSession, folder: str, payloads: bool = True, files: str = "part-*") -> DataFrame:
    """Records of all archives in ``folder``, validated; raises at the first that is malformed."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds[n]) for n in names], names=names)

        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for row in read_archive(content.as_buffer()):
                    rows.append(row)
                    size += len(row["payload"]) + 200
                    if size > 4 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    schema = ", ".join(f"{n} {'binary' if n == 'payload' else 'long' if pa.types.is_integer(kinds[n]) else 'string'}" for n in names)
    return map_batches(spark.read.format("binaryFile").option("pathGlobFilter", files).load(folder).select("content"), run, schema)


def round_trip(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write one record per row, read the archives back and return the records without payloads."""
    spark = pages.sparkSession
    folder = fresh_folder(spark, "warc")
    write(pages, folder, archive_bytes)
    return read(spark, folder, payloads=False).drop("url")


#: DuckDB: the record of each page. Rows that repeat a page id and payload share a type.
ORACLE = f"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS n, sha256(payload) AS digest FROM p),
f AS (SELECT digest, min(page_id) AS first FROM d WHERE n >= {MIN_REVISIT} GROUP BY digest)
SELECT d.page_id, d.n::BIGINT AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN f.first IS NOT NULL AND d.page_id IS DISTINCT FROM f.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first IS NOT NULL AND d.page_id IS DISTINCT FROM f.first THEN f.first END AS refers_to
FROM d LEFT JOIN f ON f.digest = d.digest
"""
