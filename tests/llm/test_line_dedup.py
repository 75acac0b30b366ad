"""Line dedup against plain counting; the index after insertions and deletions; cuckoo filters."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from talewarp.llm import line_dedup
from talewarp.llm.cuckoo import Cuckoo, Stack
from talewarp.llm.line_dedup import LineIndex

STRIP = " \t\n\x0b\x0c\r"


def keys_of(text):
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    return [lower(line.strip(STRIP)) for line in (text or "").split("\n")]


def plain(rows, least=3):
    """(doc_id, n_lines, n_dropped, text) of each row; no id is smaller than any other."""
    order = lambda d: (d is not None, d or 0)
    holders = defaultdict(set)
    for doc_id, text in rows:
        for key in keys_of(text):
            if len(key) >= 20:
                holders[key].add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line, key in zip(lines, keys_of(text), strict=True) if len(holders.get(key, ())) < least or doc_id == max(holders[key], key=order)]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def some_rows(seed, ids, more=()):
    rng = random.Random(seed)
    pool = [f"{w} line number {i} with some words" for i in range(30) for w in ("The", "ÉTÉ", "日本語の行")] + ["short", "", "   ", "x" * 19, "é" * 20, "É" * 20]
    rows = []
    for i in ids:
        lines = [rng.choice([str, str.upper, str.lower])(rng.choice(pool)) for _ in range(rng.randrange(12))] + [f"a line of document {rng.randrange(10**9)} alone"] * rng.randrange(3)
        rng.shuffle(lines)
        rows.append((i, "\n".join(rng.choice(["", " ", "\t\x0b"]) + line + rng.choice(["", "\r", " \x0c"]) for line in lines)))
    return rows + list(more)


ODD = [(None, None), (None, "the line number 1 with some words"), (3, "the line number 1 with some words\n" * 3), (3, ""), (999, "the line number 1 with some words "), (1000, "z" * 100_000 + "\nthe LINE number 1 with some words")]
SCHEMA = "doc_id long, text string"


def cleaned(index, frame):
    return sorted((tuple(r) for r in index.clean(frame).collect()), key=str)


@pytest.mark.parametrize("increments", [1, 3])
def test_equals_plain_counting(spark, increments):
    rows = some_rows(1, range(200), ODD) + [(5000 + i, "a very common line that a third of all rows hold") for i in range(100)]
    frame = spark.createDataFrame([(*r, 7) for r in rows], SCHEMA + ", hi long")
    got = line_dedup.deduplicate(frame, increments=increments)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)
    assert sum(r[2] for r in plain(rows)) > 100


def marks(index):
    """Number of marks in the filters, and all keys that documents hold."""
    stacks = defaultdict(list)
    for r in index.filters.orderBy("shard", "place").collect():
        stacks[r["shard"]].append(bytes(r["data"]))
    stacks = {k: Stack.load(line_dedup.FILTER_KEYS, v) for k, v in stacks.items()}
    keys = {(r["hi"], r["lo"]) for r in index.holders.collect()}
    for hi, lo in keys:
        assert stacks[lo % index.shards].contains(np.array([hi]).view(np.uint64), np.array([lo]).view(np.uint64)).all()
    return sum(map(len, stacks.values())), len(keys)


def test_deletion_undoes_insertion(spark):
    first, second, third = some_rows(2, range(60), ODD), some_rows(3, range(2000, 2060)), some_rows(4, range(3000, 3040))
    a, b, c = (spark.createDataFrame(x, SCHEMA) for x in (first, second, third))
    one = LineIndex.create(a)
    two = one.insert(b)
    assert cleaned(two, a.union(b)) == plain(first + second)
    with pytest.raises(ValueError, match="delete them first"):
        two.insert(b)
    back = two.delete(b.select("doc_id"))
    assert sorted(map(tuple, back.counts.collect())) == sorted(map(tuple, one.counts.collect()))
    assert marks(back) == marks(one) and marks(one)[0] == marks(one)[1]
    assert cleaned(back, a) == plain(first)

    half = [r for r in first if r[0] is None or r[0] % 2]
    again = two.delete(a.where("doc_id % 2 = 0").select("doc_id")).insert(c)
    assert cleaned(again, spark.createDataFrame(half + second + third, SCHEMA)) == plain(half + second + third)
    assert marks(again)[0] == marks(again)[1]
    none = again.delete(again.holders.select("doc_id"))
    assert none.counts.count() == none.holders.count() == marks(none)[0] == 0


def alike_keys():
    """Two lines whose keys have one mark and one bucket in the filters of one shard."""
    lines = [f"line number {i:09d} of many lines" for i in range(1_500_000)]
    digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.encode()) for x in lines), ">u8").astype(np.uint64).reshape(-1, 2)
    buckets = len(Cuckoo.of_size(line_dedup.FILTER_KEYS).table)
    place = (digests[:, 1] >> np.uint64(48) << np.uint64(32)) | (digests[:, 0] & np.uint64(buckets - 1)) << np.uint64(8) | digests[:, 1] % np.uint64(line_dedup.SHARDS)
    order = np.argsort(place)
    k = int(np.flatnonzero(place[order][1:] == place[order][:-1])[0])
    return lines[order[k]], lines[order[k + 1]]


def test_false_alarms_get_marks_of_their_own(spark):
    one, other = alike_keys()
    assert one != other
    first, second, third = [(1, one)], [(2, other), (3, other)], [(4, other), (5, one), (6, one)]
    a, b, c = (spark.createDataFrame(x, SCHEMA) for x in (first, second, third))
    index = LineIndex.create(a).insert(b)
    assert marks(index) == (2, 2) and [r["n"] for r in index.counts.collect()] == [2]
    lost = index.delete(a.select("doc_id"))
    assert marks(lost) == (1, 1)
    full = index.insert(c)
    assert cleaned(full, a.union(b).union(c)) == plain(first + second + third)
    assert cleaned(lost.insert(c), b.union(c)) == plain(second + third)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    index = LineIndex.create(empty)
    assert index.clean(empty).count() == 0 and index.insert(spark.createDataFrame([(1, None)], SCHEMA)).holders.count() == 0


def test_cuckoo_filters_hold_remove_and_grow():
    rng = np.random.default_rng(0)
    high, low = (rng.integers(0, 1 << 63, 50_000, dtype=np.uint64) for _ in range(2))
    low[:20_000] &= np.uint64((1 << 50) - 1)  # few different marks
    stack = Stack(5000)
    for k in range(0, len(high), 777):
        stack.insert(high[k : k + 777], low[k : k + 777])
    assert len(stack.filters) >= 8 and len(stack) == len(high) and stack.contains(high, low).all()
    stack.remove(high[::2], low[::2])
    assert stack.contains(high[1::2], low[1::2]).all() and len(stack) == len(high) // 2
    stack = Stack.load(5000, stack.dump())
    stack.remove(high[1::2], low[1::2])
    assert len(stack) == 0
    with pytest.raises(KeyError):
        stack.remove(high[:1], low[:1])


def test_keys_that_share_mark_and_buckets_keep_copies():
    same = np.full(30, 12345, np.uint64)
    stack = Stack(1000)
    stack.insert(same, same)
    assert len(stack) == 30 and Counter(len(f) for f in stack.filters)[8] >= 1
    for k in range(30):
        stack.remove(same[:1], same[:1])
        assert len(stack) == 29 - k
    with pytest.raises(OverflowError):
        Cuckoo.of_size(100).insert(same, same)
