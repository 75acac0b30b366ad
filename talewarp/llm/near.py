"""Near-dedup by similarity: the general form of op 5, for the pipeline's stage.

Two documents are near copies if their sets of ``SIZE``-word shingles have a Jaccard
similarity of ``SIMILARITY`` or more; groups are the components of that relation. Words
are those of ``simhash``.

Fingerprints of the shingles go through op 5's byte-position index: 14 postings of four
positional bytes each, a tally of the positional bytes that two members share in them,
and pairs with six of eight or more are candidates. At that similarity fingerprints of
64 bits differ in about ten bits, which no posting of positional bytes can guarantee; of
the pairs in ``sf0.01`` at 0.8 or more that aren't equal, none lies within two bits. So
that no link is lost, members that share one of ``BANDS`` bands of ``ROWS`` minimum
hashes of the same shingles are candidates as well (a pair at 0.8 shares one with
probability 0.9993, at 0.85 with 0.99999). Each candidate is verified by the exact
similarity of the shingles, which is what the bits of fingerprints estimate.

Exact copies (equal words) are one member. Postings of up to ``simhash.HOT`` members are
tallied: two members share a larger one, or have a whole tally. A larger posting, or a
band's bucket of more than ``hot`` members, is compared with its smallest member first. Where members of a bucket are then in different
components, those outside the largest meet ``HUBS`` of its members, so that a crowd of
near copies costs few comparisons a member. All members of buckets that are still split
then go through a prefix join, which is exact (Xiao et al., 2011): shingles are ordered
from rare to common; two sets of sizes n >= m at similarity t share a shingle that is
among the first n - ceil(tn) + 1 of the one and the first m - ceil(2tm/(1+t)) + 1 of the
other, with enough shingles after it on both sides. A passage that a crowd shares is
among those only where a document holds little else, so documents that have nothing but
the passage in common don't meet. What is compared are sorted 64-bit hashes of the
shingles of members that have a candidate; they are read from their documents once.

Defined results: null, empty and blank texts are copies of each other; texts of fewer
than ``SIZE`` words are one shingle; rows with a null id take part, and a component of
null ids alone has a null ``component_id``; repeated rows give repeated results; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TASK_WIDE_ROWS, as_bytes, by_bytes, checkpointed, map_batches, sized, small_or_not, written
from .graph import components, joined_labels
from .simhash import FEW_ROWS, SLICE_BYTES, SLICE_HASHES, _bit_counts, _hashes, blocks, first_of, keep_first, postings, tallied, with_components, with_text_key
from .simhash import HOT as HOT_POSTING

SIZE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 6
#: Members of a bucket beyond which they are compared with one of them first.
HOT = 4
#: Members of a bucket's largest component that those outside it meet.
HUBS = 8
#: Parts that the pairs of one member are dealt to, at most; rows of a shingle that meet in one part of the prefix join.
SALTS, MEETING = 64, 2048
BLOCK = 1 << 12

_rng = np.random.default_rng(5)
_FLIPS = _rng.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32)
_FACTORS = _rng.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32) | np.uint32(1)


def words_of(text: bytes) -> bytes:
    return b" ".join(text.lower().split())


def hashed_shingles(text: bytes, size: int = SIZE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    return np.unique(np.array(_hashes(text, size), np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays of distinct hashes."""
    if not len(a) and not len(b):
        return 1.0
    places = np.searchsorted(a, b)
    shared = int((a[np.minimum(places, len(a) - 1)] == b).sum()) if len(a) else 0
    return shared / (len(a) + len(b) - shared)


def buckets(text: bytes, size: int = SIZE) -> tuple[int, int, np.ndarray]:
    """Number of distinct shingles, fingerprint, and one key for each band."""
    every = np.array(_hashes(text, size), np.uint64)
    if not len(every):
        return 0, 0, np.zeros(0, np.int64)
    counts = sum(_bit_counts(every[k : k + SLICE_HASHES]) for k in range(0, len(every), SLICE_HASHES))
    print_ = np.packbits(2 * counts > len(every), bitorder="little").view(np.int64)[0]
    distinct = np.unique(every)
    short = (distinct >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(short), BLOCK):
        np.minimum(least, ((short[None, k : k + BLOCK] ^ _FLIPS) * _FACTORS).min(axis=1), out=least)
    bands = [xxhash.xxh3_64_intdigest(row.tobytes()) for row in least.reshape(BANDS, ROWS)]
    return len(distinct), int(print_), np.array(bands, np.uint64).view(np.int64)


def _marked(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text_key, key, size, fp, buckets`` of every row; rows of equal words have equal keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text", SLICE_BYTES):
                texts = as_bytes(part.column("text"))
                found = [buckets(t, size) for t in texts]
                keys = [xxhash.xxh3_128_digest(words_of(t)) for t in texts]
                columns = [part.column("doc_id"), part.column("text_key"), pa.array(keys, pa.binary()), pa.array([n for n, *_ in found], pa.int32()), pa.array([fp for _, fp, _ in found], pa.int64()), pa.array([b for *_, b in found], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "key", "size", "fp", "buckets"])

    source = with_text_key(docs, id_col, text_col)
    return map_batches(source, run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, text_key long, key binary, size int, fp long, buckets array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """``node, hashes`` of the wanted nodes, whose first documents are read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text", SLICE_BYTES):
                found = [hashed_shingles(t, size).tobytes() for t in as_bytes(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(found, pa.binary())], names=["node", "hashes"])

    rows = wanted.count()
    firsts = wanted.select("node", F.col("first.doc_id").alias("_id"), F.col("first.text_key").alias("_text_key"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_text_key"))
    found = with_text_key(docs, id_col, text_col).join(small_or_not(firsts, FEW_ROWS), same).select("node", "text")
    return sized(map_batches(found, run, "node long, hashes binary").groupBy("node").agg(F.first("hashes").alias("hashes")), rows, TASK_WIDE_ROWS)


def _verified(pairs: DataFrame, sets: DataFrame, least: float, nodes: int) -> DataFrame:
    """The pairs (a, b) that are similar enough; a member of many pairs is dealt to many tasks.

    A member's own set comes first, and those that it is compared with stream past.
    ``nodes`` is the number of sets, all of which the joins read, however few pairs there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.uint64)
        for batch in batches:
            keep = []
            for own, raw in zip(batch.column("own"), batch.column("hashes"), strict=True):
                found = np.frombuffer(raw.as_buffer(), np.uint64)
                if own.as_py():
                    held = found.copy()
                keep.append(not own.as_py() and similarity(held, found) >= least)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    rows = pairs.count()
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    own = salted.select("a", "salt").distinct().join(sets.withColumnRenamed("node", "a"), "a").select("a", "salt", F.lit(True).alias("own"), F.lit(None).cast("long").alias("b"), "hashes")
    other = salted.join(sets.withColumnRenamed("node", "b"), "b").select("a", "salt", F.lit(False).alias("own"), "b", "hashes")
    both = sized(own, rows + nodes, TASK_WIDE_ROWS).unionByName(sized(other, rows + nodes, TASK_WIDE_ROWS))
    dealt = sized(both.repartition("a", "salt"), 2 * rows, TASK_WIDE_ROWS).sortWithinPartitions("a", "salt", F.desc("own"))
    return checkpointed(map_batches(dealt, run, "a long, b long"))


def _posted(distinct: DataFrame) -> DataFrame:
    """``band, bucket, node, size``: bands of minimum hashes from 0, and postings of the byte-position index from ``BANDS`` on."""
    bands = distinct.select("node", "size", F.posexplode("buckets").alias("band", "bucket"))
    index = postings(distinct.where("size > 0"), "node", "size")
    return bands.unionByName(index.select("node", "size", (F.col("positions") + BANDS).alias("band"), F.col("bytes").alias("bucket")))


def _alike_prints(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of members of postings whose fingerprints share six positional bytes or more by the tally."""
    return tallied(members.select("node", (F.col("band") - BANDS).alias("positions"), F.col("bucket").alias("bytes")), node="node")


def _linked(docs: DataFrame, size: int, least: float, hot: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text_key, first`` of every row; see ``simhash.with_components``."""
    marked = checkpointed(_marked(docs, size, id_col, text_col))
    rows = marked.count() * (BANDS + len(blocks()))  # of postings, at most
    distinct = marked.groupBy("key").agg(*first_of(), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("buckets").alias("buckets"))
    distinct = checkpointed(sized(distinct, rows).withColumn("node", F.monotonically_increasing_id()))
    posted = checkpointed(_posted(distinct))
    shared = checkpointed(sized(posted.groupBy("band", "bucket").agg(F.count("*").alias("n"), F.min("node").alias("hub"), F.min_by("size", "node").alias("hub_size")).where("n > 1"), rows))
    members = checkpointed(sized(posted.join(shared, ["band", "bucket"]), rows))
    alike = F.least("a_size", "b_size") >= F.greatest("a_size", "b_size") * F.lit(least) - 1e-6

    def side(rows: DataFrame, name: str, *more: str) -> DataFrame:
        return rows.select("band", "bucket", F.col("node").alias(name), F.col("size").alias(f"{name}_size"), *(F.col(c).alias(f"{name}_{c}") for c in more))

    banded, crowded = F.col("band") < BANDS, F.col("n") > F.when(F.col("band") < BANDS, hot).otherwise(max(hot, HOT_POSTING))
    few, many = members.where(banded & ~crowded), members.where(crowded)
    prints = _alike_prints(members.where(~banded & ~crowded))
    cold = side(few, "a").join(side(few, "b"), ["band", "bucket"]).where("a < b").where(alike).select("a", "b")
    star = many.select(F.col("hub").alias("a"), F.col("hub_size").alias("a_size"), F.col("node").alias("b"), F.col("size").alias("b_size")).where("a <> b").where(alike).select("a", "b")
    pairs = checkpointed(sized(sized(prints, rows).unionByName(sized(cold, rows)).unionByName(star).distinct(), rows))
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(many.select("node")).distinct()
    wanted = checkpointed(sized(distinct.select("node", "first").join(sized(wanted, rows), "node", "left_semi"), rows))
    sets = checkpointed(_sets(docs, wanted, size, id_col, text_col))
    nodes = sets.count()
    labels = components(_verified(pairs, sets, least, nodes))
    if rows := many.count():
        rest = _split(many, labels, rows)
        main = F.col("label") == F.col("main")
        hubs = rest.where(main).groupBy("band", "bucket").agg(*(F.min_by("node", F.xxhash64("node", F.lit(i))).alias(f"h{i}") for i in range(HUBS)))
        met = sized(rest.where(~main).join(sized(hubs, rows), ["band", "bucket"]), rows).select("node", F.explode(F.array(*(f"h{i}" for i in range(HUBS)))).alias("hub"))
        more = checkpointed(sized(met.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti"), HUBS * rows))
        labels = joined_labels(labels, _verified(more, sets, least, nodes))
        crowd = checkpointed(sized(_split(many, labels, rows).select("node", "label").distinct(), rows))
        last = checkpointed(sized(_prefix_pairs(crowd, sets, least).join(pairs.unionByName(more), ["a", "b"], "left_anti"), HUBS * rows))
        labels = joined_labels(labels, _verified(last, sets, least, nodes))
    return with_components(marked.select("doc_id", "text_key", "key"), distinct.select("key", "node", "n", "first"), labels, "key", "node")


def _split(members: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """``band, bucket, node, label, main`` of members whose bucket has several components; main is the largest one's label."""
    told = checkpointed(sized(members.select("band", "bucket", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), rows))
    parts = sized(told.groupBy("band", "bucket", "label").agg(F.count("*").alias("n")), rows)
    split = parts.groupBy("band", "bucket").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    split = sized(split.select("band", "bucket", "main"), rows)
    return checkpointed(sized(told.join(split, ["band", "bucket"]).select("band", "bucket", "node", "label", "main"), rows))


def _prefix_pairs(crowd: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of nodes with different labels that may be similar: all that are, and few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                found = np.frombuffer(batch.column("hashes")[row].as_buffer(), np.int64)
                for k in range(0, len(found), SLICE_HASHES):
                    part = found[k : k + SLICE_HASHES]
                    same = (pa.array(np.full(len(part), batch.column(c)[row].as_py(), np.int64)) for c in ("node", "label"))
                    yield pa.RecordBatch.from_arrays([*same, pa.array(np.full(len(part), len(found), np.int32)), pa.array(part)], names=["node", "label", "size", "shingle"])

    rows = written(map_batches(crowd.join(sets, "node"), run, "node long, label long, size int, shingle long"), "near-shingles")
    common = rows.groupBy("shingle").agg(F.count("*").alias("times"))
    rare_first = Window.partitionBy("node").orderBy("times", "shingle")
    placed = rows.join(common, "shingle").withColumn("after", F.col("size") - F.row_number().over(rare_first) + 1)  # with the shingle itself
    probes = checkpointed(placed.where((F.col("times") > 1) & (F.col("after") >= F.col("size") * least - 1e-6)))
    parts = F.ceil(F.col("times") / MEETING).cast("int")
    a = probes.select("shingle", F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"), F.col("node").alias("a"), F.col("label").alias("a_label"), F.col("size").alias("a_size"), F.col("after").alias("a_after"))
    b = probes.where(F.col("after") >= F.col("size") * (2 * least / (1 + least)) - 1e-6)
    b = b.select("shingle", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("node").alias("b"), F.col("label").alias("b_label"), F.col("size").alias("b_size"), F.col("after").alias("b_after"))
    enough = F.least("a_after", "b_after") >= (F.col("a_size") + F.col("b_size")) * (least / (1 + least)) - 1e-6
    larger = F.struct("b_size", "b") < F.struct("a_size", "a")
    met = a.join(b, ["shingle", "part"]).where(larger & (F.col("a_label") != F.col("b_label")) & enough)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_copies(docs: DataFrame, size: int = SIZE, least: float = SIMILARITY, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, component_id`` of every row."""
    return _linked(docs, size, least, hot, id_col, text_col).select("doc_id", F.col("first.doc_id").alias("component_id"))


def deduplicate(docs: DataFrame, size: int = SIZE, least: float = SIMILARITY, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, that with the smallest id; see ``simhash.keep_first``."""
    return keep_first(docs, _linked(docs, size, least, hot, id_col, text_col), id_col, text_col)
