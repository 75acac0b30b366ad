"""SimHash near-dedup (op 5): byte-position inverted index with count filtering.

Fingerprints: words of the lower-cased (A-Z) text, 3-word shingles, XXH64 with seed 42,
and a bit for each position that more than half of the hashes set.

Two fingerprints that differ in at most two bits agree in at least six of their eight
positional bytes. A list for a single position and byte has a 256th of all
fingerprints, so a posting takes four positions with their bytes. The 14 postings of a
fingerprint are the sets of four positions whose numbers have the exclusive or zero;
every three positions lie in exactly one of them. Two fingerprints that differ in d
bytes thus share 14, 7 or 3 postings for d = 0, 1 or 2, which together hold every
position that agrees, and one at most for more. The tally of a pair is the number of
positional bytes in the postings that it shares; pairs with six or more are kept, and
their bits verified.

Only distinct fingerprints are indexed, so exact copies cost one posting. A posting of
more than ``HOT`` fingerprints isn't paired: the key of its members is extended to all
eight bytes but for one bit, by the 65 points at most one bit away, and two
fingerprints are within two bits exactly if they share such a point. That needs 65
rows a member instead of all pairs, and loses no link between components: a pair has
either both members in a hot posting, or a whole tally. Components come from iterated
minimum labels.

Defined results: null, empty and blank texts have fingerprint zero and are linked like
any other; texts of one or two words hash the whole sequence; rows with a null id take
part, and a component of null ids alone has a null ``component_id``; repeated rows give
repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, by_bytes, checkpointed, fresh_name, joined, map_batches, quoted, sized, small_or_not
from .graph import components

SHINGLE, SEED, MAX_BITS = 3, 42, 2
#: Members of a posting beyond which they are linked by points, not in pairs.
HOT = 24
#: Rows to be dropped, up to which they are broadcast (about 100 bytes each).
FEW_ROWS = 500_000
SLICE_BYTES, SLICE_HASHES = 2 << 20, 1 << 18


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _hashes(text: bytes, size: int) -> list[int]:
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - size].tolist(), ends[size - 1 :].tolist(), strict=True)]


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint_array(texts: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """64-bit fingerprints of texts, as signed integers."""
    out = np.zeros(len(texts), np.uint64)
    for i, text in enumerate(texts):
        found = np.array(_hashes(text, size), np.uint64)
        if len(found):
            counts = sum(_bit_counts(found[k : k + SLICE_HASHES]) for k in range(0, len(found), SLICE_HASHES))
            out[i] = np.packbits(2 * counts > len(found), bitorder="little").view(np.uint64)[0]
    return out.view(np.int64)


def fingerprints(docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_key, fp`` of every row; fp is the fingerprint as a long, text_key a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text", SLICE_BYTES):
                fps = fingerprint_array(as_bytes(part.column("text")), size)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(fps)], names=["doc_id", "text_key", "fp"])

    source = with_text_key(docs, id_col, text_col)
    return map_batches(source, run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, text_key long, fp long")


def with_text_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_key, text`` of every row."""
    return docs.select(quoted(id_col).alias("doc_id"), F.xxhash64(quoted(text_col)).alias("text_key"), quoted(text_col).alias("text"))


def blocks() -> list[int]:
    """The 14 postings as sets of four positions (a bit for each of the eight)."""
    return [sum(1 << p for p in four) for four in combinations(range(8), 4) if four[0] ^ four[1] ^ four[2] ^ four[3] == 0]


def _mask(positions: int) -> int:
    """The bits of a fingerprint at some byte positions."""
    return _signed(sum(0xFF << (8 * p) for p in range(8) if positions >> p & 1))


def postings(distinct: DataFrame, *keep: str) -> DataFrame:
    """``fp, positions, bytes``: the byte-position index of fingerprints, with columns to keep."""
    keys = F.array(*(F.struct(F.lit(p).alias("positions"), F.col("fp").bitwiseAND(F.lit(_mask(p))).alias("bytes")) for p in blocks()))
    return distinct.select("fp", *keep, F.explode(keys).alias("key")).select("fp", *keep, "key.positions", "key.bytes")


def tallied(members: DataFrame, least: int = 8 - MAX_BITS, node: str = "fp") -> DataFrame:
    """Pairs (a, b) of members of postings that share at least ``least`` positional bytes; ``node`` names the members."""
    left, right = (members.select("positions", "bytes", F.col(node).alias(x)) for x in "ab")
    shared = left.join(right, ["positions", "bytes"]).where("a < b")
    return shared.groupBy("a", "b").agg(F.bit_or("positions").alias("agree")).where(F.bit_count("agree") >= least).select("a", "b")


def links(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """Pairs (a, b) of fingerprints within two bits that connect all that are within two bits."""
    posted = checkpointed(postings(distinct))
    shared = checkpointed(posted.groupBy("positions", "bytes").agg(F.count("*").alias("n")).where("n > 1"))
    members = checkpointed(posted.join(shared, ["positions", "bytes"]))
    cold = tallied(members.where(F.col("n") <= hot)).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)

    points = [F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_signed(1 << k))) for k in range(64))]
    spread = members.where(F.col("n") > hot).select("fp").distinct().select("fp", F.explode(F.array(*points)).alias("point"))
    hubs = spread.groupBy("point").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1").select("point", "hub")
    warm = checkpointed(spread).join(checkpointed(hubs), "point").where("hub < fp").select(F.col("hub").alias("a"), F.col("fp").alias("b"))
    return cold.unionByName(warm).distinct()


def first_of() -> tuple[Column, Column]:
    """Aggregates ``n, first``: a group's number of rows, and its smallest id with a text of that id; no id comes last."""
    smallest = F.min("doc_id")
    text = F.coalesce(F.min_by("text_key", "doc_id"), F.min("text_key"))
    return F.count("*").alias("n"), F.struct(smallest.isNull().alias("missing"), smallest.alias("doc_id"), text.alias("text_key")).alias("first")


def with_components(marked: DataFrame, distinct: DataFrame, roots: DataFrame, key: str, node: str) -> DataFrame:
    """``marked`` with ``first``, the smallest (id, text) of its component.

    ``distinct`` has ``first_of`` for each ``key``, and the ``node`` by which ``roots`` (``components``) name it.
    """
    rows, linked = distinct.count(), roots.count()
    grouped = checkpointed(sized(distinct.join(roots.withColumnRenamed("node", "_node"), F.col(node) == F.col("_node")).select(node, "label", "first"), linked))
    smallest = checkpointed(sized(grouped.groupBy("label").agg(F.min("first").alias("smallest")), linked))
    changed = sized(grouped.join(smallest, "label").select(F.col(node).alias("_node"), "smallest"), linked)
    labels = checkpointed(sized(distinct.join(changed, F.col(node) == F.col("_node"), "left").select(key, "n", F.coalesce("smallest", "first").alias("first")), rows))
    return joined(marked, labels, key)


def _linked(docs: DataFrame, size: int, hot: int, id_col: str, text_col: str) -> DataFrame:
    marked = checkpointed(fingerprints(docs, size, id_col, text_col))
    distinct = checkpointed(marked.groupBy("fp").agg(*first_of()))
    return with_components(marked, distinct, components(links(distinct, hot)), "fp", "fp")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row."""
    linked = _linked(docs, size, hot, id_col, text_col)
    return linked.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def keep_first(docs: DataFrame, linked: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that aren't the first of their component.

    A document is an id with a text: where an id is repeated with another text, each is
    judged for itself. Rows that repeat id and text are one document and stay or go
    together. Documents to be dropped are broadcast while they are few, so that texts
    aren't shuffled.
    """
    own = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_key")
    gone, key = (fresh_name(docs, x) for x in ("dropped_id", "dropped_key"))
    dropped = checkpointed(linked.where(~own.eqNullSafe(F.col("first"))).select(F.col("doc_id").alias(gone), F.col("text_key").alias(key)).distinct())
    same = quoted(id_col).eqNullSafe(F.col(gone)) & (F.xxhash64(quoted(text_col)) == F.col(key))
    return docs.join(small_or_not(dropped, FEW_ROWS), same, "left_anti")


def deduplicate(docs: DataFrame, size: int = SHINGLE, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, that with the smallest id; see ``keep_first``."""
    return keep_first(docs, _linked(docs, size, hot, id_col, text_col), id_col, text_col)
