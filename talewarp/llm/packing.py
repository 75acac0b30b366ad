"""Best-fit packing (op 1): pattern packing by non-negative least squares.

1. Tasks tokenize whole texts, append an end id to each, and cut only texts longer than
   a sequence into pieces. What is kept of a piece is its place, length and checksum.
2. Spark counts pieces by length: at most ``capacity`` numbers reach the driver.
3. The driver plans on that histogram alone. It enumerates patterns of up to three
   lengths that fill a sequence, fits repeat counts r >= 0 to the histogram in the
   least-squares sense, and rounds down. To what is left it fits, in the same way,
   patterns that leave some tokens free: for every pair of lengths the longest third
   that there is. The rest is packed by best fit, longest length first, group of equal
   pieces by group. Of the shares of free tokens in ``SLACKS`` the one counts that gives
   the fewest sequences. The driver's work depends on the number of lengths, not on
   that of pieces.
4. Pieces of one length are numbered by salted window and prefix sums. A length has a
   salt for every ``PIECES_PER_SALT`` of its pieces, dealt by row, so that a length that
   holds a third of all pieces, or a row that is repeated as often, still spreads; the
   n-th piece of a length takes the n-th place planned for that length, found by binary
   search in the broadcast plan.

The plan grows with ``capacity`` only. Losing executors recomputes tasks; the pieces
are checkpointed once, before the histogram is taken, so all uses see the same rows.

Defined results: null and empty texts are one piece, the end id alone; repeated rows
are packed each on its own; null ids are kept; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, by_bytes, checkpointed, map_batches
from .token_counts import SLICE_BYTES, default_tokenizer_path, encoder, split_long

CAPACITY, END_ID = 2048, 0
#: Shares of a sequence that near-full patterns may leave free.
SLACKS = (1 / 32, 1 / 128, 0)
#: Pieces that share a window when pieces of one length are numbered.
PIECES_PER_SALT = 20_000


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece of every row."""
    path = path or default_tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for part in by_bytes(batch, "text", SLICE_BYTES):
                texts = as_bytes(part.column("text"))
                if enc.safe and len(texts) == 1 and len(texts[0]) > SLICE_BYTES:
                    flat = np.concatenate([enc.ids([x])[0] for x in split_long(texts[0], SLICE_BYTES)])
                    counts = np.array([len(flat)])
                else:
                    flat, counts = enc.ids(texts)
                ends = np.cumsum(counts)
                tokens = np.insert(flat.astype("<u4"), ends, np.uint32(end_id))
                sizes = counts + 1
                first = np.cumsum(sizes) - sizes
                cuts = -(-sizes // capacity)
                row = np.repeat(np.arange(len(texts)), cuts)
                piece = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                start = piece * capacity
                length = np.minimum(sizes[row] - start, capacity)
                raw = memoryview(tokens.tobytes())
                at = 4 * (first[row] + start)
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(source, run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long", path)


def patterns(capacity: int, present: np.ndarray, slack: int = 0) -> np.ndarray:
    """Multisets of at most three present lengths with sums of ``capacity`` - ``slack`` or more, as zero-padded rows.

    Of those that share their two shortest lengths, the one with the longest third.
    """
    values = np.unique(np.append(present, 0))
    upto = values[np.searchsorted(values, np.arange(capacity + 1), side="right") - 1]  # the longest present length within each
    found = []
    for a in values:
        middle = values[(values >= a) & (2 * values <= capacity - a)]
        last = upto[capacity - a - middle]
        fits = (last >= middle) & (last > 0) & (a + middle + last >= capacity - slack)
        found.append(np.column_stack([np.full(int(fits.sum()), a), middle[fits], last[fits]]))
    return np.concatenate(found)


def fit_counts(rows: np.ndarray, histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradient.

    Minimises |A r - h|^2 with A the number of times that a pattern has each length;
    a pattern touches three lengths, so A is never written out.
    """
    size, goal = len(histogram), histogram.astype(float)
    goal[0] = 0

    def forward(r: np.ndarray) -> np.ndarray:
        out = sum(np.bincount(rows[:, k], weights=r, minlength=size) for k in range(3))
        out[0] = 0
        return out

    def backward(e: np.ndarray) -> np.ndarray:
        return e[rows[:, 0]] + e[rows[:, 1]] + e[rows[:, 2]]

    probe = np.ones(len(rows))
    norm = 1.0
    for _ in range(12):
        probe = backward(forward(probe))
        norm = np.linalg.norm(probe)
        probe /= norm
    rate = 1 / (1.05 * norm)
    r = z = np.zeros(len(rows))
    t = 1.0
    for _ in range(steps):
        gradient = backward(forward(z) - goal)
        new = np.maximum(0, z - rate * gradient)
        if np.dot(gradient, new - r) > 0:
            t = 1.0
        nxt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, r, t = new + (t - 1) / nxt * (new - r), new, nxt
    return r


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Lengths in a sequence, and the number of sequences that hold them.

    Every piece of the histogram (index: length) has exactly one place.
    """
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        out.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    out += _fitted(left, capacity, 0)
    best: list[tuple[tuple[int, ...], int]] | None = None
    for slack in sorted({int(share * capacity) for share in SLACKS}, reverse=True):
        rest = left.copy()
        found = (_fitted(rest, capacity, slack, 100) if slack else []) + _best_fit(rest, capacity)
        if best is None or sum(n for _, n in found) < sum(n for _, n in best):
            best = found
    return out + best


def _fitted(left: np.ndarray, capacity: int, slack: int, steps: int = 400) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and their whole counts, which are taken from ``left``."""
    present, out = np.flatnonzero(left), []
    if not len(present) or not len(rows := patterns(capacity, present, slack)):
        return out
    repeats = fit_counts(rows, left, steps)
    # largest first, never more than the pieces that are left
    for k in np.argsort(-repeats, kind="stable"):
        if repeats[k] < 1:
            break
        lengths = tuple(int(x) for x in rows[k][::-1] if x)
        need = {x: lengths.count(x) for x in lengths}
        n = min(int(repeats[k]), *(int(left[x]) // c for x, c in need.items()))
        if n > 0:
            for x, c in need.items():
                left[x] -= n * c
            out.append((lengths, n))
    return out


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on groups of equal bins: pieces go to the fullest bins that they fit."""
    bins: list[list[list]] = [[] for _ in range(capacity + 1)]  # by free space: [lengths, number]
    free = np.zeros(capacity + 1, bool)
    for length in range(len(left) - 1, 0, -1):
        rest = int(left[length])
        while rest:
            fits = np.flatnonzero(free[length:])
            if len(fits):
                space = length + int(fits[0])
                lengths, number = bins[space].pop()
                free[space] = bool(bins[space])
                each = min(space // length, max(1, rest // number))
                used = min(number, rest // each)
                if number > used:
                    bins[space].append([lengths, number - used])
                    free[space] = True
            else:
                space, lengths = capacity, ()
                each = min(space // length, rest)
                used = rest // each
            rest -= used * each
            bins[space - each * length].append([(*lengths, *[length] * each), used])
            free[space - each * length] = True
    return [(tuple(lengths), number) for groups in bins for lengths, number in groups]


class Places:
    """For each length, runs of places: the n-th piece of a length finds sequence and offset."""

    def __init__(self, planned: list[tuple[tuple[int, ...], int]], capacity: int):
        runs: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]
        sequence = 0
        for lengths, number in planned:
            offset = 0
            for x in lengths:
                runs[x].append((number, sequence, offset))
                offset += x
            sequence += number
        flat = [r for group in runs for r in group]
        self.first_run = np.cumsum([0, *map(len, runs)])
        number, self.sequence, self.offset = (np.array([r[k] for r in flat], np.int64) for k in range(3))
        self.before = np.cumsum(number) - number
        base = np.append(self.before, number.sum())
        self.base = base[self.first_run[:-1]]

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = self.base[length] + rank
        run = np.searchsorted(self.before, place, side="right") - 1
        return self.sequence[run] + place - self.before[run], self.offset[run]


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all rows with ``sequence_id`` and ``offset``, gapless from 0."""
    spark = docs.sparkSession
    parts = checkpointed(pieces(docs, capacity, path, end_id, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    histogram = np.zeros(capacity + 1, np.int64)
    for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect():
        histogram[r["length"]] = r["n"]
    places = spark.sparkContext.broadcast(Places(plan(histogram, capacity), capacity))
    salts = F.element_at(F.lit((histogram // PIECES_PER_SALT + 1).tolist()), F.col("length").cast("int") + 1)

    salted = parts.withColumn("salt", F.pmod(F.xxhash64("row"), salts))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("row")) - 1)
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = ranked.join(before.select("length", "salt", F.coalesce("before", F.lit(0)).alias("before")), ["length", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.value.find(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    numbered = ranked.select(*names, (F.col("before") + F.col("rank")).alias("rank"))
    return map_batches(numbered, run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
