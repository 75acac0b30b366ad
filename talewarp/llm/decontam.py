"""Benchmark decontamination (op 8): CGK embedding, bit-sampling LSH, edit verification.

Benchmark items and documents are sequences of lower-cased words; in scripts that don't
space their words (Han, Kana, Thai, Lao, Burmese, Khmer) each character is a word. A
document holds an item of n words if some window lies within edit distance
floor((1 - ``SIMILARITY``) n) of it, counted in words; items of fewer than five words are
thus matched exactly. An item without any word (nothing but marks) is held where its
text stands in the document's, letter by letter.

Windows of an item's size start at every word of a whole document. A lossless filter
leaves those that can match: k edits spare all but k of an item's words, so of its
k + ``SPARE`` rarest words (its anchors) at least ``SPARE`` stand within n + k words.
Words of more than ``CROWD`` items are anchors only of items that have no k + 1 rarer
ones, and count accordingly.
Where they do, windows start at the place that an anchor implies, and up to k words
before and after it. Windows that remain, and
the items of that size, take the CGK random walk (Chakraborty, Goldenberg and Koucky,
2016): at each step the current word is written, and a hash of step and word decides
whether to move on, which maps a small edit distance to a small Hamming distance.
``BITS`` sampled coordinates of a walk make a bucket key; ``REPEATS`` independent walks
reach the recall that ``tests/llm`` measures. Windows that share a bucket with an item
are verified by shared words and then by exact edit distance with free ends.

The benchmark is a query set: it is broadcast in blocks of at most ``BLOCK_BYTES`` of
text, one pass over the documents each. There is no join or shuffle of documents.

Defined results: null and empty texts hold nothing; null and blank items take no part;
repeated items are each reported, under their ids or null; repeated documents, and
those without an id, give a row each; of windows with equal distance the first found
counts; other columns are ignored (``decontaminate`` keeps them); an empty table of
documents or items gives an empty result. Texts of any length are read whole, a part at
a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, keep_rows, map_batches

SIMILARITY = 0.8
BITS, REPEATS, STRETCH, SPARE = 3, 32, 2, 5
BLOCK_BYTES, SLICE_BYTES = 16 << 20, 4 << 20
#: Items that share a word beyond which it is no anchor if others are enough, and pairs of an anchor's place and item that are held at once.
CROWD, EXPANDED = 64, 1 << 20
#: Comparisons of words that are held at once.
CELLS = 1 << 24
#: Characters of a long text that are split into words at once.
PART_CHARS = 1 << 20
_WORDS = re.compile(r"\w+").findall
_SPACE = re.compile(r"\s")
#: Ranges of the scripts that don't space their words.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def words_of(text: str) -> list[str]:
    text = text.lower()
    if not text.isascii() and _UNSPACED.search(text):
        text = _UNSPACED.sub(r" \g<0> ", text)
    return _WORDS(text)


def _parts(text: str) -> Iterator[str]:
    """A text in parts of about ``PART_CHARS`` that are cut at white space."""
    at = 0
    while len(text) - at > PART_CHARS and (cut := _SPACE.search(text, at + PART_CHARS)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def allowed(n: int, similarity: float = SIMILARITY) -> int:
    """Edits allowed in an item of ``n`` words."""
    return int((1 - similarity) * n + 1e-9)


def fitting_distance(item: np.ndarray, text: np.ndarray) -> int:
    """Smallest edit distance of ``item`` and any stretch of ``text``."""
    steps = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, word in enumerate(item):
        best = np.empty_like(row)
        best[0] = i + 1
        best[1:] = np.minimum(row[:-1] + (text != word), row[1:] + 1)
        row = np.minimum.accumulate(best - steps) + steps
    return int(row.min())


@lru_cache(maxsize=4096)
def _walk(n: int, repeat: int, bits: int) -> tuple[list[int], np.ndarray]:
    """Sampled steps of a repetition, and the odd multipliers that hash words at each step."""
    rng = np.random.default_rng((n, repeat))
    sampled = np.sort(rng.choice(STRETCH * n, min(bits, STRETCH * n), replace=False)).tolist()
    return sampled, rng.integers(1, 1 << 32, STRETCH * n, dtype=np.uint64) * np.uint64(2 * 0x5DEECE66D) | np.uint64(1)


def padded(windows: np.ndarray) -> np.ndarray:
    """Windows (word numbers in rows) with an end mark, as the walk reads them."""
    return np.concatenate([windows.astype(np.uint64) + np.uint64(2), np.ones((len(windows), 1), np.uint64)], axis=1)


def walk_keys(rows: np.ndarray, repeat: int, bits: int = BITS) -> np.ndarray:
    """Bucket keys of ``padded`` windows of one length in one repetition."""
    n, flat = rows.shape[1] - 1, rows.ravel()
    sampled, salt = _walk(n, repeat, bits)
    at = np.arange(len(rows)) * (n + 1)
    end = at + n
    key = np.zeros(len(rows), np.uint64)
    for t in range(sampled[-1] + 1):
        word = flat[at]
        if t in sampled:
            key = (key ^ word) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        at += (word * salt[t] >> np.uint64(63)).astype(np.int64)
        np.minimum(at, end, out=at)
    return key


class Index:
    """The items of one block, by number of words, with their buckets."""

    def __init__(self, items: list[tuple[int | None, str]], similarity: float = SIMILARITY, bits: int = BITS, repeats: int = REPEATS):
        self.numbers: dict[str, int] = {}
        self.bits, self.repeats = bits, repeats
        ids: dict[tuple[str, ...], list[int]] = {}
        marks: dict[str, list[int]] = {}
        for item, text in items:
            if words := tuple(words_of(text or "")):
                ids.setdefault(words, []).append(item)
            elif bare := (text or "").strip():
                marks.setdefault(bare, []).append(item)
        for words in ids:
            for w in words:
                self.numbers.setdefault(w, len(self.numbers) + 1)
        self.marks = list(marks)
        self.ids = [*ids.values(), *marks.values()]
        self.items = [np.array([self.numbers[w] for w in words], np.int32) for words in ids]
        self.edits = [allowed(len(x), similarity) for x in self.items]
        self.by_size: dict[int, list[int]] = {}
        seen = np.bincount(np.concatenate(self.items), minlength=len(self.numbers) + 1) if self.items else np.zeros(1, int)
        letters = np.array([0, *map(len, self.numbers)])
        posted: list[tuple[int, int, int]] = []  # word, item, place in the item
        need: list[int] = []
        for k, (x, e) in enumerate(zip(self.items, self.edits, strict=True)):
            self.by_size.setdefault(len(x), []).append(k)
            anchors = np.lexsort((-letters[x], seen[x]))[: e + SPARE]
            # words of a crowd of items tell little; one more than the edits is enough to lose nothing
            anchors = anchors[(seen[x[anchors]] <= CROWD) | (np.arange(len(anchors)) <= e)]
            need.append(len(anchors) - e)
            posted += [(int(x[i]), k, int(i)) for i in anchors]
        postings = np.array(sorted(posted), np.int64).reshape(-1, 3)
        self.posting_ends = np.searchsorted(postings[:, 0], np.arange(len(self.numbers) + 2))
        self.posted_item, self.posted_place = postings[:, 1], postings[:, 2]
        self.need = np.array(need, np.int64)
        self.span = np.array([len(x) + e for x, e in zip(self.items, self.edits, strict=True)], np.int64)
        self.reach = max((len(x) + e for x, e in zip(self.items, self.edits, strict=True)), default=0)
        #: By size and repetition the items' keys in order, and the items.
        self.buckets: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.stacked: dict[int, np.ndarray] = {}
        self.row_of = np.zeros(len(self.items), np.int64)
        for n, members in self.by_size.items():
            own = np.array(members, np.int32)
            self.stacked[n] = np.stack([self.items[k] for k in members])
            self.row_of[own] = np.arange(len(own))
            stacked = padded(self.stacked[n])
            self.buckets[n] = []
            for r in range(repeats):
                keys = walk_keys(stacked, r, bits)
                order = np.argsort(keys, kind="stable")
                self.buckets[n].append((keys[order], own[order]))
        self.size_of = np.array([len(x) for x in self.items], np.int64)

    def find(self, texts: list[str]) -> list[dict[int, tuple[int, int]]]:
        """For each text the items that it holds: distance, and the word where the window starts."""
        out: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
        for k, bare in enumerate(self.marks, len(self.items)):
            for matches, text in zip(out, texts, strict=True):
                if bare in text:
                    matches[k] = (0, sum(len(words_of(p)) for p in _parts(text[: text.index(bare)])))
        if not self.items or not texts:
            return out
        get = self.numbers.get
        numbers = [np.concatenate([np.array([get(w, 0) for w in words_of(p)], np.int32) for p in _parts(t)]) for t in texts]
        gap = np.zeros(self.reach, np.int32)
        joined = np.concatenate([x for n in numbers for x in (n, gap)] or [gap])
        lengths = np.array([len(n) + self.reach for n in numbers])
        first = np.cumsum(lengths) - lengths
        ends = first + np.array([len(n) for n in numbers])
        starts = self._starts(joined, first, ends)
        for n, found in starts.items():
            for a in range(0, len(found), 20_000):
                self._match(n, self.edits[self.by_size[n][0]], found[a : a + 20_000], joined, first, ends, out)
        return out

    def _starts(self, joined: np.ndarray, first: np.ndarray, ends: np.ndarray) -> dict[int, np.ndarray]:
        """By item size, where windows start that hold enough anchors of one item; within the document of the anchor.

        Occurrences of anchors are looked at ``EXPANDED`` (place, item) pairs at a time,
        and with them those that follow within the longest window.
        """
        count = self.posting_ends[joined + 1] - self.posting_ends[joined]
        at = np.flatnonzero(count)
        total = np.cumsum(count[at])
        out: dict[int, list[np.ndarray]] = {}
        a = 0
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + EXPANDED, side="right")))
            upto = int(np.searchsorted(at, at[b - 1] + self.reach))
            for n, found in self._anchored(at[a:upto], at[b - 1], joined, first, ends):
                out.setdefault(n, []).append(found)
            a = b
        return {n: np.unique(np.concatenate(found)) for n, found in out.items()}

    def _anchored(self, at: np.ndarray, last_place: int, joined: np.ndarray, first: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Item size and starts of windows whose first anchor stands at one of the places ``at`` up to ``last_place``."""
        begin = self.posting_ends[joined[at]]
        count = self.posting_ends[joined[at] + 1] - begin
        which = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
        item, place, pos = self.posted_item[which], self.posted_place[which], np.repeat(at, count)
        order = np.argsort(item * (len(joined) + 1) + pos, kind="stable")
        item, place, pos = item[order], place[order], pos[order]
        last = np.minimum(np.arange(len(item)) + self.need[item] - 1, len(item) - 1)
        enough = (np.arange(len(item)) + self.need[item] <= len(item)) & (item[last] == item) & (pos[last] - pos < self.span[item])
        hit = np.flatnonzero(enough & (pos <= last_place))
        guess, doc, size = pos[hit] - place[hit], np.searchsorted(first, pos[hit], side="right") - 1, self.size_of[item[hit]]
        for n in np.unique(size).tolist():
            its = size == n
            k, mine = self.edits[self.by_size[n][0]], doc[its]
            yield n, np.unique(np.clip(guess[its][:, None] + np.arange(-k, k + 1), first[mine][:, None], ends[mine][:, None] - 1))

    def _match(self, n: int, k: int, starts: np.ndarray, joined: np.ndarray, first: np.ndarray, ends: np.ndarray, out: list[dict[int, tuple[int, int]]]) -> None:
        windows = padded(np.concatenate([joined, np.zeros(n, np.int32)])[starts[:, None] + np.arange(n)])
        candidates = np.zeros(0, np.int64)
        for r in range(self.repeats):
            keys, (held, members) = walk_keys(windows, r, self.bits), self.buckets[n][r]
            begin = np.searchsorted(held, keys)
            met = np.flatnonzero(held[np.minimum(begin, len(held) - 1)] == keys)
            begin, count = begin[met], np.searchsorted(held, keys[met], side="right") - begin[met]
            total, a = np.cumsum(count), 0
            while a < len(met):  # a bounded number of pairs at a time, of which few share enough words
                b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + EXPANDED, side="right")))
                times = count[a:b]
                items = members[np.repeat(begin[a:b] - (np.cumsum(times) - times), times) + np.arange(times.sum())]
                pairs = np.setdiff1d(np.repeat(met[a:b], times) << 32 | items, candidates, assume_unique=True)
                candidates = np.concatenate([candidates, pairs[self._share_words(pairs, starts, joined, first, ends, n, k)]])
                a = b
        candidates.sort()
        for i, item in zip((candidates >> 32).tolist(), (candidates & 0xFFFFFFFF).tolist(), strict=True):
            start = int(starts[i])
            doc = int(np.searchsorted(first, start, side="right")) - 1
            begin = max(int(first[doc]), start - k)
            stretch = joined[begin : min(int(ends[doc]), start + n + k)]
            words = self.items[item]
            if item in out[doc] and out[doc][item][0] == 0:
                continue
            distance = fitting_distance(words, stretch)
            if distance <= k and (item not in out[doc] or distance < out[doc][item][0]):
                out[doc][item] = (distance, start - int(first[doc]))


    def _share_words(self, pairs: np.ndarray, starts: np.ndarray, joined: np.ndarray, first: np.ndarray, ends: np.ndarray, n: int, k: int) -> np.ndarray:
        """Whether all but ``k`` of an item's words stand around a window, for pairs of window and item."""
        enough = np.zeros(len(pairs), bool)
        step = max(1, CELLS // (n * (n + 2 * k)))
        for a in range(0, len(pairs), step):
            part = pairs[a : a + step]
            start, words = starts[part >> 32], self.stacked[n][self.row_of[part & 0xFFFFFFFF]]
            doc = np.searchsorted(first, start, side="right") - 1
            places = start[:, None] + np.arange(-k, n + k)
            inside = (places >= first[doc][:, None]) & (places < ends[doc][:, None])
            around = np.where(inside, joined[np.clip(places, 0, len(joined) - 1)], -1)
            enough[a : a + step] = (words[:, :, None] == around[:, None, :]).any(axis=2).sum(axis=1) >= n - k
        return enough


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int | None, str]]]:
    """The benchmark's rows in blocks of bounded size."""
    rows = benchmark.where("text IS NOT NULL").select("item_id", "text")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    number = -(-size // block_bytes) or 1
    for k in range(number):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(number)) == k) if number > 1 else rows
        yield [(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``doc_id, item_id, distance, item_words, start_word``: each item that a document holds."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = None
    for items in _blocks(benchmark, block_bytes):
        index = docs.sparkSession.sparkContext.broadcast(Index(items, **options))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            held = index.value
            for batch in batches:
                for part in by_bytes(batch, "text", SLICE_BYTES):
                    rows = [
                        (row, item, distance, len(held.items[k]) if k < len(held.items) else 0, start)
                        for row, matches in enumerate(held.find([t or "" for t in part.column("text").to_pylist()]))
                        for k, (distance, start) in matches.items()
                        for item in held.ids[k]
                    ]
                    columns = list(zip(*rows, strict=True)) or [()] * 5
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.int32()) for c in columns[2:])],
                        names=["doc_id", "item_id", "distance", "item_words", "start_word"],
                    )

        part = map_batches(source, run, f"doc_id {kind}, item_id long, distance int, item_words int, start_word int")
        found = part if found is None else found.unionByName(part)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, **options) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item."""
    for items in _blocks(benchmark, block_bytes):
        index = docs.sparkSession.sparkContext.broadcast(Index(items, **options))
        docs = keep_rows(docs, lambda texts, index=index: [not m for m in index.value.find(texts)], SLICE_BYTES)
    return docs
