"""Line dedup (op 13): sharded cuckoo filters backed by exact reference-count tables.

A line's key is the line without ASCII white space at its ends and with A-Z lower-cased;
keys of at least ``MIN_CHARS`` code points count, as 128-bit hashes. The index is kept up
to date document by document and can be undone:

* ``holders``: a row for each key and document that holds it.
* ``filters``: for each shard of the keys, cuckoo filters with one copy of the mark of
  every key that any document holds (``cuckoo``). Unlike a Bloom filter they support
  deletion. They take about 2.3 bytes a key, and one task holds one shard's.
* ``counts``: the exact number of documents and the largest id, for keys in two or more
  documents.

``insert`` asks the filters which of a batch's keys may be known. Keys that a filter
denies are new; they are added to it and need no look-up. Only keys that it affirms, and
those that occur several times in the batch, are counted exactly: from ``counts``, or, if
they aren't there, from ``holders`` (a key in one document, or a false alarm, which is
then added to the filter as well). ``delete`` lowers the counts of the documents' keys,
finds the largest id anew where it went, and takes the marks of keys that no document
holds any more out of the filters. So inserting documents and deleting them again leaves
the same counts, and filters that hold the same keys.

``clean`` drops the lines whose keys ``MIN_DOCS`` documents or more hold, except in the
document with the largest id.

A key with a third of all rows is one row a slice when it is dealt to its shard; counts
are summed map-side, and heavy keys are broadcast when rows are joined with their counts.

Defined results: null and empty texts are one empty line; rows that share an id are one
document, and all their lines stay or go alike; rows without an id are one document that
is smaller than any other; documents that the index doesn't know lose only what others
hold if their id is known, else nothing; an empty table gives an empty index and result;
other columns are ignored. Ids that the index holds must be deleted before they are
inserted again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, by_bytes, checkpointed, map_batches, quoted, small_or_not, written
from .cuckoo import Stack

MIN_CHARS, MIN_DOCS = 20, 3
#: Keys of a filter, and rows of a first batch for each shard.
FILTER_KEYS, SHARD_ROWS, SHARDS = 1 << 17, 1 << 20, 16
#: Rows of keys whose repetitions are merged before they are dealt to shards.
MERGED_ROWS = 1 << 18
#: Rows that are broadcast at most (keys with documents, 40 bytes each).
FEW_ROWS = 500_000
SLICE_BYTES = 4 << 20
KEY = ["hi", "lo"]


def line_key(line: bytes) -> bytes:
    return line.strip().lower()


def counts_as_line(key: bytes, least: int = MIN_CHARS) -> bool:
    """Whether a key has at least ``least`` code points."""
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least)


def _digests(text: bytes, least: int) -> list[bytes]:
    """The key's hash for every line, empty for lines that don't count."""
    return [xxhash.xxh3_128_digest(key) if counts_as_line(key := line_key(line), least) else b"" for line in text.split(b"\n")]


def holders_of(docs: DataFrame, least: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``hi, lo, doc_id``: the keys of each row, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text", SLICE_BYTES):
                keys = [set(_digests(t, least)) - {b""} for t in as_bytes(part.column("text"))]
                flat = np.frombuffer(b"".join(k for own in keys for k in own), ">i8").astype(np.int64).reshape(-1, 2)
                of = np.repeat(np.arange(len(keys)), [len(own) for own in keys])
                yield pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1]), part.column("doc_id").take(pa.array(of))], names=["hi", "lo", "doc_id"])

    source = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    return map_batches(source, run, f"hi long, lo long, doc_id {source.schema['doc_id'].dataType.simpleString()}")


def _runs(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and number of each run of equal keys."""
    new = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])[: len(hi)])
    return new, np.diff(np.append(new, len(hi)))


def _merged(holders: DataFrame) -> DataFrame:
    """``hi, lo, many``: keys of slices of ``holders``, once a slice; many where it had several rows."""

    def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        hi, lo = (np.concatenate(x) for x in zip(*parts, strict=True))
        by = np.lexsort((lo, hi))
        hi, lo = hi[by], lo[by]
        new, times = _runs(hi, lo)
        return pa.RecordBatch.from_arrays([pa.array(hi[new]), pa.array(lo[new]), pa.array(times > 1)], names=["hi", "lo", "many"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows = [], 0
        for batch in batches:
            parts.append(tuple(batch.column(c).to_numpy() for c in KEY))
            rows += batch.num_rows
            if rows >= MERGED_ROWS:
                yield merge(parts)
                parts, rows = [], 0
        if rows:
            yield merge(parts)

    return map_batches(holders.select(*KEY), run, "hi long, lo long, many boolean")


_STATE = pa.schema([("shard", pa.int32()), ("place", pa.int32()), ("data", pa.binary()), ("hi", pa.int64()), ("lo", pa.int64()), ("known", pa.bool_())])


class _Shard:
    """One shard in a task: its filters, and keys as they come in order."""

    def __init__(self, number: int, work: str):
        self.number, self.work, self.tables, self.stack = number, work, [], None
        self.hi, self.lo, self.many = (np.zeros(0, t) for t in (np.int64, np.int64, bool))

    def take(self, rows: pa.RecordBatch) -> pa.RecordBatch:
        """Filters first, then keys; the last key waits, as more of it may come."""
        data = rows.column("data")
        self.tables += data.drop_null().to_pylist()
        keys = rows.filter(data.is_null())
        for name, kind in (("hi", np.int64), ("lo", np.int64), ("many", bool)):
            setattr(self, name, np.concatenate([getattr(self, name), keys.column(name).to_numpy(zero_copy_only=False).astype(kind)]))
        new, _ = _runs(self.hi, self.lo)
        return self.handle(int(new[-1]) if len(new) else 0)

    def handle(self, upto: int) -> pa.RecordBatch:
        hi, lo, many = self.hi[:upto], self.lo[:upto], self.many[:upto]
        self.hi, self.lo, self.many = self.hi[upto:], self.lo[upto:], self.many[upto:]
        new, times = _runs(hi, lo)
        repeated = times > 1
        if len(new):
            repeated |= np.add.reduceat(many, new, dtype=np.int64) > 0
        hi, lo = hi[new], lo[new]
        high, low = hi.view(np.uint64), lo.view(np.uint64)
        if self.stack is None:
            self.stack = Stack.load(FILTER_KEYS, self.tables)
        told = known = np.zeros(len(hi), bool)
        if self.work == "remove":
            self.stack.remove(high, low)
        elif self.work == "add":
            self.stack.insert(high, low)
        else:
            known = self.stack.contains(high, low)
            self.stack.insert(high[~known], low[~known])
            told = known | repeated
        n = int(told.sum())
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, self.number, np.int32)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(hi[told]), pa.array(lo[told]), pa.array(known[told])], schema=_STATE)

    def end(self) -> Iterator[pa.RecordBatch]:
        yield self.handle(len(self.hi))
        for place, table in enumerate(self.stack.dump()):
            yield pa.RecordBatch.from_pylist([{"shard": self.number, "place": place, "data": table}], schema=_STATE)


def _passed(filters: DataFrame, keys: DataFrame, shards: int, work: str = "ask") -> tuple[DataFrame, DataFrame]:
    """Keys (``hi, lo, many``) go through their shards' filters: the filters after it, and ``hi, lo, known`` of keys to be counted.

    Keys that a filter denies are added to it; with ``work`` "add" or "remove" all keys are added or taken out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            numbers = batch.column("shard").to_numpy()
            edges = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if now is None or now.number != numbers[a]:
                    if now:
                        yield from now.end()
                    now = _Shard(int(numbers[a]), work)
                yield now.take(batch.slice(a, b - a))
        if now:
            yield from now.end()

    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    held = filters.select("shard", "place", "data", none("long", "hi"), none("long", "lo"), none("boolean", "many"))
    asked = keys.select(F.pmod("lo", F.lit(shards)).cast("int").alias("shard"), none("int", "place"), none("binary", "data"), "hi", "lo", "many")
    dealt = held.unionByName(asked).repartition("shard").sortWithinPartitions("shard", F.col("hi").isNotNull(), "place", "hi", "lo")
    out = written(map_batches(dealt, run, "shard int, place int, data binary, hi long, lo long, known boolean"), "line-filters")
    return out.where("data IS NOT NULL").select("shard", "place", "data"), out.where("hi IS NOT NULL").select("hi", "lo", "known")


def _counted(holders: DataFrame, keys: DataFrame) -> DataFrame:
    """``hi, lo, n, last`` of ``keys``: how many documents hold it, and the largest id."""
    found = holders.join(small_or_not(keys.select(*KEY), FEW_ROWS), KEY, "left_semi").distinct()
    return found.groupBy(*KEY).agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))


def _with_last(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """``hi, lo, doc_id, last`` of the rows whose keys are in ``counts``.

    Keys with more than a ten-thousandth of all rows are fewer than ten thousand, so they
    are broadcast; no other key is large enough to hold up a task.
    """
    heavy = F.col("n") > max(10_000, (counts.agg(F.sum("n")).first()[0] or 0) // 10_000)
    few = F.broadcast(counts.where(heavy).select(*KEY, "last", F.lit(True).alias("heavy")))
    told = rows.join(few, KEY, "left")
    rest = told.where("heavy IS NULL").drop("last").join(counts.where(~heavy).select(*KEY, "last"), KEY)
    columns = [*KEY, "doc_id", "last"]
    return told.where("heavy").select(*columns).unionByName(rest.select(*columns))


@dataclass(frozen=True)
class LineIndex:
    """The state as DataFrames of the shared folder; each change gives a new index, and the old one stays valid."""

    shards: int
    holders: DataFrame
    filters: DataFrame
    counts: DataFrame
    min_chars: int = MIN_CHARS

    @classmethod
    def create(cls, docs: DataFrame, min_chars: int = MIN_CHARS, increments: int = 1, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """An index of ``docs``, inserted in ``increments`` parts by a hash of the id."""
        rows = written(holders_of(docs, min_chars, id_col, text_col), "line-holders")
        spark, kind = docs.sparkSession, rows.schema["doc_id"].dataType.simpleString()
        shards = max(SHARDS, -(-rows.count() // SHARD_ROWS))
        empty = lambda schema: spark.createDataFrame([], schema)
        index = cls(shards, rows.limit(0), empty("shard int, place int, data binary"), empty(f"hi long, lo long, n long, last {kind}"), min_chars)
        for part in range(increments):
            index = index._with(rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(increments)) == part))
        return replace(index, holders=rows)

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """The index with further documents."""
        rows = written(holders_of(docs, self.min_chars, id_col, text_col), "line-holders")
        mine, new = self.holders.select("doc_id").distinct(), rows.select(F.col("doc_id").alias("new")).distinct()
        if mine.join(new, F.col("doc_id").eqNullSafe(F.col("new")), "left_semi").limit(1).count():
            raise ValueError("the index holds some of these ids; delete them first")
        return self._with(rows)

    def _with(self, rows: DataFrame) -> LineIndex:
        filters, told = _passed(self.filters, _merged(rows), self.shards)
        own = _counted(rows, told)
        unsure = checkpointed(told.where("known").join(self.counts, KEY, "left_anti"))
        earlier = checkpointed(_counted(self.holders, unsure))
        false = unsure.join(earlier, KEY, "left_anti").select(*KEY, F.lit(False).alias("many"))
        if false.limit(1).count():
            filters, _ = _passed(filters, false, self.shards, "add")
        counts = self.counts.unionByName(own).unionByName(earlier).groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("last").alias("last"))
        return replace(self, holders=self.holders.unionByName(rows), filters=filters, counts=written(counts.where("n > 1"), "line-counts"))


    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
        """The index without the documents whose ids ``ids`` has."""
        ids = checkpointed(ids.select(quoted(id_col).alias("_gone")).distinct())
        same = F.col("doc_id").eqNullSafe(F.col("_gone"))
        some = small_or_not(ids, FEW_ROWS)
        left = written(self.holders.join(some, same, "left_anti"), "line-holders")
        lost = checkpointed(self.holders.join(some, same, "left_semi").distinct().groupBy(*KEY).agg(F.count("*").alias("lost")))
        touched = checkpointed(self.counts.join(small_or_not(lost, FEW_ROWS), KEY).withColumn("n", F.col("n") - F.col("lost")).drop("lost"))
        still = _counted(left, touched.where("n > 1")).select(*KEY, "n", "last")
        counts = self.counts.join(small_or_not(touched.select(*KEY), FEW_ROWS), KEY, "left_anti").unionByName(still)
        gone = lost.join(touched.where("n > 0").select(*KEY), KEY, "left_anti").select(*KEY, F.lit(False).alias("many"))
        filters, _ = _passed(self.filters, gone, self.shards, "remove")
        return replace(self, holders=left, filters=filters, counts=written(counts, "line-counts"))

    def clean(self, docs: DataFrame, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``doc_id, n_lines, n_dropped, text`` of every row of ``docs``, which the index holds."""
        often = self.counts.where(F.col("n") >= min_docs)
        found = _with_last(self.holders, often).where(~F.col("doc_id").eqNullSafe(F.col("last"))).select("doc_id", *KEY).distinct()
        found = checkpointed(found)
        dropped = found.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct(*KEY)).alias("dropped"))
        if found.limit(FEW_ROWS + 1).count() <= FEW_ROWS:
            dropped = F.broadcast(dropped)
        source = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
        least = self.min_chars

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in by_bytes(batch, "text", SLICE_BYTES):
                    yield cleaned(part)

        def cleaned(part: pa.RecordBatch) -> pa.RecordBatch:
            lists = part.column("dropped")
            sizes, at = lists.value_lengths().fill_null(0).to_pylist(), 0
            flat = lists.flatten()
            keys = np.stack([flat.field(0).to_numpy(), flat.field(1).to_numpy()], axis=1).astype(">i8").tobytes()
            lines, gone, texts = [], [], []
            for text, size in zip(as_bytes(part.column("text")), sizes, strict=True):
                own = text.split(b"\n")
                kept = own
                if size:
                    drop = {keys[k : k + 16] for k in range(at, at + 16 * size, 16)}
                    at += 16 * size
                    kept = [line for line, digest in zip(own, _digests(text, least), strict=True) if digest not in drop]
                lines.append(len(own))
                gone.append(len(own) - len(kept))
                texts.append(b"\n".join(kept))
            columns = [part.column("doc_id"), pa.array(lines, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_lines", "n_dropped", "text"])

        met = source.join(dropped, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select("doc_id", "text", "dropped")
        return map_batches(met, run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_lines long, n_dropped long, text string")


def deduplicate(docs: DataFrame, increments: int = 2, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` inserted into a new index in ``increments`` parts, then cleaned by it."""
    return LineIndex.create(docs, min_chars, increments, id_col, text_col).clean(docs, min_docs, id_col, text_col)


def digests(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: DuckDB: every line's key, the documents that hold it, and what is left of each text.
ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM docs),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
told AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.last AS dropped FROM keyed k LEFT JOIN common c ON c.key = k.key)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT dropped), '')) AS kept_sha256
FROM told GROUP BY r
"""
