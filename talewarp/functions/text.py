"""Text functions: byte-bounded splitting and truncation, chunk identity, times and paths.

Splitting and truncation count bytes and must not cut a character, which no built-in
expression does in a loop; they are Arrow functions, and short texts never reach them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

MAX_CHUNK_BYTES, OVERLAP_BYTES, SEARCH_BYTES = 8000, 1500, 1000
STORE_CHUNK_BYTES = 32 << 10


def _inside(data: bytes, at: int) -> bool:
    """True if ``at`` lies within a character."""
    return at < len(data) and data[at] & 0xC0 == 0x80


def split_bytes(data: bytes, most: int = MAX_CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> list[bytes]:
    """Overlapping parts of at most ``most`` bytes.

    A part ends after the last blank line in its final stretch, else after the last
    sentence or line, else at ``most``; the next begins ``overlap`` bytes before.
    """
    out, start = [], 0
    while len(data) - start > most:
        end = start + most
        begin = max(start, end - SEARCH_BYTES)
        window = data[begin:end]
        if (blank := window.rfind(b"\n\n")) > 0:
            end = begin + blank + 2
        elif (stop := max(window.rfind(mark) for mark in (b". ", b"! ", b"? ", b"\n"))) > 0:
            end = begin + stop + 1
        while end > start and _inside(data, end):
            end -= 1
        out.append(data[start:end])
        start = max(start + 1, end - overlap)
        while _inside(data, start):
            start += 1
    return [*out, data[start:]]


def truncate_bytes(data: bytes, most: int) -> bytes:
    """At most ``most`` bytes, ending before a character that doesn't fit."""
    if len(data) <= most:
        return data
    while most and _inside(data, most):
        most -= 1
    return data[:most]


def plain_split_bytes(data: bytes, most: int = STORE_CHUNK_BYTES) -> list[bytes]:
    """Parts of at most ``most`` bytes without overlap, never inside a character."""
    out = []
    while len(data) > most:
        part = truncate_bytes(data, most)
        out.append(part)
        data = data[len(part) :]
    return [*out, data]


def _per_text(split):
    @pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: None if t is None else [p.decode() for p in split(t.encode())])

    return run


def split_content(text: str | Column) -> Column:
    """Overlapping parts of a text (``split_bytes``) as an array; null stays null."""
    col = F.col(text) if isinstance(text, str) else text
    return F.when(F.octet_length(col) <= MAX_CHUNK_BYTES, F.array(col)).otherwise(_per_text(split_bytes)(F.when(F.octet_length(col) > MAX_CHUNK_BYTES, col)))


def split_store_content(text: str | Column) -> Column:
    """Parts of at most 32 KiB without overlap."""
    col = F.col(text) if isinstance(text, str) else text
    return F.when(F.octet_length(col) <= STORE_CHUNK_BYTES, F.array(col)).otherwise(_per_text(plain_split_bytes)(F.when(F.octet_length(col) > STORE_CHUNK_BYTES, col)))


def truncated(text: Column, most: int, mark: str = "") -> Column:
    """At most ``most`` bytes of a text, with ``mark`` after a text that was cut.

    A character that the limit would split is left out: at most three of its bytes
    remain at the end of the cut, and they are taken off again.
    """
    cut = F.substring(F.encode(text, "UTF-8"), 1, most)
    tail = [F.substring(F.encode(text, "UTF-8"), most + 1 - k, 1) for k in range(4)]
    inside = [F.conv(F.hex(t), 16, 10).cast("int").between(128, 191) for t in tail]
    size = F.when(~inside[0], most).when(~inside[1], most - 1).when(~inside[2], most - 2).otherwise(most - 3)
    kept = F.decode(F.substring(cut, F.lit(1), size), "UTF-8")
    return F.when(F.octet_length(text) > most, F.concat(kept, F.lit(mark))).otherwise(text)


def go_json(value: Column) -> Column:
    """A variant as JSON with sorted keys and the three HTML characters escaped."""
    text = F.to_json(value)
    return F.replace(F.replace(F.replace(text, F.lit("<"), F.lit("\\u003c")), F.lit(">"), F.lit("\\u003e")), F.lit("&"), F.lit("\\u0026"))


def short_id(*parts: Column) -> Column:
    """The first 16 hexadecimal digits of the SHA-256 of the parts, one after another."""
    return F.substring(F.sha2(F.concat(*parts).cast("binary"), 256), 1, 16)


def domain_id(domain: str, *parts: Column) -> Column:
    """The SHA-256 of a domain, a zero byte and the parts."""
    return F.sha2(F.concat(F.lit(domain.encode() + b"\0"), *(p.cast("binary") for p in parts)), 256)


def nanos(text: Column) -> Column:
    """Nanoseconds since the epoch of RFC 3339 text with an offset; null if it is none."""
    pattern = r"^(\d{4}-\d\d-\d\d)T(\d\d:\d\d:\d\d)(?:\.(\d{1,9})\d*)?(Z|[+-]\d\d:\d\d)$"
    day, clock, fraction, zone = (F.regexp_extract(text, pattern, i) for i in range(1, 5))
    whole = F.try_to_timestamp(F.concat(day, F.lit(" "), clock, F.when(zone == "Z", "+00:00").otherwise(zone)), F.lit("yyyy-MM-dd HH:mm:ssXXX"))
    return F.when(text.rlike(pattern), F.unix_seconds(whole) * 1_000_000_000 + F.rpad(fraction, 9, "0").cast("long"))


def time_key(ns: Column) -> Column:
    """Canonical time text: fraction without trailing zeros, offset +00:00."""
    rest = F.pmod(ns, F.lit(1_000_000_000))
    seconds = F.call_function("div", ns - rest, F.lit(1_000_000_000))
    fraction = F.regexp_replace(F.lpad(rest.cast("string"), 9, "0"), "0+$", "")
    return F.concat(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss"), F.when(rest > 0, F.concat(F.lit("."), fraction)).otherwise(""), F.lit("+00:00"))


def basename(path: Column, fallback: str = "unknown") -> Column:
    """The last part of a path; ``fallback`` for a root or an empty path."""
    name = F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
    return F.when(F.coalesce(name, F.lit("")).isin("", ".", ".."), F.lit(fallback)).otherwise(name)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def decoded_project(encoded: Column) -> Column:
    """A path from a folder name in which dashes stand for slashes."""
    name = F.trim(F.coalesce(encoded, F.lit("")))
    return F.when(name == "", "/unknown").when(name.contains(".."), "/invalid/path").otherwise(F.concat(F.lit("/"), F.replace(F.regexp_replace(name, "^-", ""), F.lit("-"), F.lit("/"))))


def segment_after(path: Column, folder: str, last_ok: bool = True) -> Column:
    """The path part after the first part named ``folder``, or null."""
    parts = F.split(path, "/")
    at = F.array_position(parts, folder)
    found = F.when((at > 0) & (at + (0 if last_ok else 1) < F.size(parts)), F.try_element_at(parts, (at + 1).cast("int")))
    return F.nullif(found, F.lit(""))


def rollout_session(path: Column) -> Column:
    """The 36 hexadecimal characters at the end of a file's stem, lower-cased, or null."""
    return F.nullif(F.lower(F.regexp_extract(stem(path), r"([0-9a-fA-F-]{36})$", 1)), F.lit(""))


def first_text(*values: Column) -> Column:
    """The first value that is neither null nor empty; else empty."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values), F.lit(""))
