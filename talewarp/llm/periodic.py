"""Periodic run detection (op 12): branching tandem repeats in an enhanced suffix array.

A run is a stretch of consecutive words with smallest period q, at least ``MIN_WORDS``
words and ``MIN_PERIODS`` periods long, that no neighbouring word extends keeping period
q. The texts of a slice are one sequence of word numbers with a number of its own after
each text, so that no repeat crosses texts.

1. Suffix array by doubling: numbers that are equal for equal blocks of h words, for h
   times two from round to round; only suffixes that are not yet told apart are sorted
   again. The numbers of all rounds stay and give common prefixes by halving.
2. LCP intervals: every place of the LCP array splits its interval, whose depth is the
   value there, into two sides, up to the nearest smaller values. There are no tree nodes.
3. Of each interval the suffixes i on the smaller side are taken, n log n in all; where
   the inverse suffix array puts i + depth or i - depth on the other side, a square of
   period depth starts at i or at i - depth. It is branching: the two suffixes share
   ``depth`` words exactly, so the square is the last one of its period in its stretch.
   A run of four periods has four suffixes in its interval, so smaller ones are passed
   over; so are depths over a quarter of the longest text.
4. Squares are rotated to the left as long as the word before equals the last one, in
   blocks of the rounds' lengths, which gives the whole stretch; stretches found with
   several periods are merged, and the smallest stays.

One map without a shuffle. Memory is about 200 bytes a word of a slice, that is of the
longest text where it is longer than ``SLICE_BYTES``.

Defined results: null, empty and blank texts have no words and no runs; rows with a null
id and repeated rows are analysed like any other; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, by_bytes, map_batches, quoted

MIN_WORDS, MIN_PERIODS = 6, 4
SLICE_BYTES = 1 << 20
#: Suffixes that are looked at together.
CHUNK = 1 << 19

Levels = list[tuple[int, np.ndarray]]
RUN = "struct<start: long, length: long, period: long>"


def suffix_array(words: np.ndarray) -> tuple[np.ndarray, Levels]:
    """Suffixes in order, and (h, numbers) where numbers are equal for equal blocks of h words.

    ``words`` are positive, and the last one occurs once. The last numbers are the inverse.
    """
    n = len(words)
    bits = max(int(words.max()).bit_length(), 1)
    h = max(1, min(3, 63 // bits))
    key = np.zeros(n, np.int64)
    for k in range(h):
        key <<= bits
        key[: n - k] |= words[k:]
    order = np.argsort(key)
    number = np.empty(n, np.int32)
    open_ = np.arange(n)
    key, levels = key[order], []
    while len(open_):
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(heads, len(open_)))
        number = number.copy()
        number[order[open_]] = np.repeat(open_[heads], sizes)
        levels.append((h, number))
        open_ = open_[np.repeat(sizes > 1, sizes)]
        at = order[open_]
        # a block that occurs twice doesn't hold the last word, so at + h is a place
        key = number[at].astype(np.int64) * n + number[at + h]
        by = np.argsort(key)
        key, order[open_] = key[by], at[by]
        h *= 2
    return order, levels


def common_prefix(a: np.ndarray, b: np.ndarray, words: np.ndarray, levels: Levels) -> np.ndarray:
    """Number of equal words from the different places ``a`` and ``b`` on."""
    out = np.zeros(len(a), np.int64)
    active = np.flatnonzero(levels[0][1][a] == levels[0][1][b])
    for h, number in reversed(levels):
        further = out[active]
        out[active] += h * (number[a[active] + further] == number[b[active] + further])
    active = np.arange(len(a))
    for _ in range(levels[0][0] - 1):
        further = out[active]
        active = active[words[a[active] + further] == words[b[active] + further]]
        out[active] += 1
    return out


def common_suffix(a: np.ndarray, b: np.ndarray, words: np.ndarray, levels: Levels) -> np.ndarray:
    """Number of equal words before the places ``a`` < ``b``."""
    out = np.zeros(len(a), np.int64)
    for h, number in [*reversed(levels), *[(1, words)] * (levels[0][0] - 1)]:
        left = a - out - h
        out += h * ((left >= 0) & (number[np.maximum(left, 0)] == number[np.maximum(b - out - h, 0)]))
    return out


def smaller_values(lcp: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the nearest one to its left whose value is no larger, and to its right whose value is smaller.

    The first and the last value are smaller than all others. A pyramid of minimums is
    climbed from each place until it meets a small enough value, and descended again.
    """
    pyramid = [lcp]
    while len(pyramid[-1]) > 1:
        below = pyramid[-1]
        if len(below) % 2:
            below = pyramid[-1] = np.append(below, np.iinfo(below.dtype).max)
        pyramid.append(np.minimum(below[::2], below[1::2]))

    def nearest(side: int) -> np.ndarray:
        """side: 1 to the right (smaller), 0 to the left (no larger)."""
        least = lcp[places] - side
        node, waiting, met = places.copy(), np.arange(len(places)), []
        for values in pyramid[:-1]:
            beside = node[waiting] ^ 1
            found = (beside & 1 == side) & (values[beside] <= least[waiting])
            met.append(waiting[found])
            node[waiting[found]] = beside[found]
            waiting = waiting[~found]
            node[waiting] >>= 1
        going = np.zeros(0, np.int64)
        for values, here in zip(pyramid[-2::-1], met[::-1], strict=True):
            if len(going):
                near = 2 * node[going] + (1 - side)
                node[going] = np.where(values[near] <= least[going], near, near ^ 1)
            going = np.concatenate([going, here])
        return node

    return nearest(0), nearest(1)


def branching_squares(order: np.ndarray, inverse: np.ndarray, lcp: np.ndarray, longest: int, least: int = MIN_PERIODS) -> tuple[np.ndarray, np.ndarray]:
    """``start, period`` of the squares whose two halves' suffixes part right after them."""
    n = len(order)
    places = np.flatnonzero((lcp > 0) & (lcp <= longest // least))
    low, high = smaller_values(lcp, places)
    wide = high - low >= least
    places, low, high = places[wide], low[wide], high[wide]
    left = places - low <= high - places
    first, size = np.where(left, low, places), np.minimum(places - low, high - places)
    from_, to = np.where(left, places, low), np.where(left, high, places)
    depth, ends = lcp[places].astype(np.int64), np.cumsum(size)
    starts, periods = [], []
    at = 0
    while at < len(places):
        done = ends[at - 1] if at else 0
        upto = max(int(np.searchsorted(ends, done + CHUNK, side="right")), at + 1)
        of = np.repeat(np.arange(at, upto), size[at:upto])
        i = order[first[of] + np.arange(len(of)) - (ends[of] - size[of] - done)]
        for other, start in ((i + depth[of], i), (i - depth[of], i - depth[of])):
            inside = inverse[np.clip(other, 0, n - 1)]
            hit = (other >= 0) & (other < n) & (inside >= from_[of]) & (inside < to[of])
            starts.append(start[hit])
            periods.append(depth[of[hit]])
        at = upto
    return (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, periods))


def runs_of(words: np.ndarray, longest: int, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start, length, period`` of all runs, by start and period. Numbers of one word each divide the texts."""
    order, levels = suffix_array(words)
    lcp = np.full(len(words) + 1, -1, np.int32)
    lcp[1:-1] = common_prefix(order[:-1], order[1:], words, levels)
    square, period = branching_squares(order, levels[-1][1], lcp, longest, min_periods)
    start = square - common_suffix(square, square + period, words, levels)
    length = square + 2 * period - start
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    new &= length >= np.maximum(min_words, min_periods * period)
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period; ties go to the smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


Arrange = Callable[[object, int], np.ndarray | None]


def analysed(ids: list, texts: list[bytes], arrange: Arrange | None = None, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """For each text its runs, and its words without those after the first period of a run.

    ``arrange`` may tell, for an id and a number of words, in which order words are read.
    """
    numbers = defaultdict(count(1).__next__)
    split, taken, coded = [], [], []
    for id_, text in zip(ids, texts, strict=True):
        words = text.split()
        code = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        at = arrange(id_, len(words)) if arrange and words else None
        split.append(words)
        taken.append(at)
        coded.append(code if at is None else code[at])
    ends = np.cumsum([len(c) + 1 for c in coded])
    joined = np.zeros(ends[-1] if len(ends) else 0, np.int64)
    for k, (code, end) in enumerate(zip(coded, ends, strict=True)):
        joined[end - 1 - len(code) : end - 1] = code
        joined[end - 1] = len(numbers) + 1 + k
    start, length, period = runs_of(joined, max(map(len, coded)), min_words, min_periods) if len(joined) else (np.zeros(0, np.int64),) * 3
    bounds = np.searchsorted(start, np.append(0, ends))
    for k, words in enumerate(split):
        own, first = slice(bounds[k], bounds[k + 1]), ends[k] - 1 - len(words)
        found = list(zip((start[own] - first).tolist(), length[own].tolist(), period[own].tolist(), strict=True))
        if found:
            edge = np.zeros(len(words) + 1, np.int64)
            for s, n, p in found:
                edge[s + p] += 1
                edge[s + n] -= 1
            left = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
            kept = [words[i] for i in (left if taken[k] is None else taken[k][left]).tolist()]
        else:
            kept = words if taken[k] is None else [words[i] for i in taken[k].tolist()]
        yield found, b" ".join(kept)


def periodic_runs(docs: DataFrame, arrange: Arrange | None = None, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, runs, strongest, collapsed`` of every row; ``collapsed`` keeps a run's first period only."""
    source = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text", SLICE_BYTES):
                found = list(analysed(part.column("doc_id").to_pylist(), as_bytes(part.column("text")), arrange, min_words, min_periods))
                named = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] for runs, _ in found]
                best = [(b := strongest(runs)) and dict(zip(("start", "length", "period"), b, strict=True)) for runs, _ in found]
                columns = [part.column("doc_id"), pa.array(named, pa.list_(run_type)), pa.array(best, run_type), pa.array([t for _, t in found], pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "runs", "strongest", "collapsed"])

    return map_batches(source, run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, runs array<{RUN}>, strongest {RUN}, collapsed string")


def planted(doc_id: object, n: int) -> np.ndarray | None:
    """The order in which the query reads the words of every tenth document (by crc32 of the id): periodic from a place on."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def digests(found: DataFrame) -> DataFrame:
    """``periodic_runs`` as numbers and digests, a row for each document."""
    best = F.col("strongest")
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.call_function("div", best["length"] * 1000, best["period"]).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
