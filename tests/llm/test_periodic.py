"""Periodic runs against a comparison of every period with every place."""

import hashlib
import random
import zlib
from fractions import Fraction

from talewarp.llm import periodic


def plain_runs(words, least=6, times=4):
    found = {}
    for p in range(1, len(words) // times + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, times * p):
                found.setdefault((i, j + p - i), p)
            i = max(i + 1, j)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def random_text(rng):
    size, n = rng.choice([1, 2, 3, 5]), rng.choice([0, 1, 2, 5, 10, 30, 80, 200])
    words = [rng.choice("abcdefg"[:size]) for _ in range(n)]
    if n and rng.random() < 0.5:
        p = rng.randrange(1, max(2, n // 3))
        words = (words[:p] * n)[:n]
        if rng.random() < 0.5:
            words[rng.randrange(n)] = "z"
    return rng.choice([" ", "\n", "\x0b \t"]).join(words)


def test_equals_every_period_at_every_place():
    rng = random.Random(1)
    for _ in range(400):
        texts = [random_text(rng) for _ in range(rng.randrange(1, 6))]
        for text, (runs, kept) in zip(texts, periodic.analysed(list(texts), [t.encode() for t in texts]), strict=True):
            words = text.split()
            want = plain_runs(words)
            assert runs == want and kept.decode().split() == collapsed(words, want)


def test_other_bounds():
    words = "a b a b a b c c c".split()
    ((runs, _),) = periodic.analysed([1], [" ".join(words).encode()], min_words=3, min_periods=3)
    assert runs == plain_runs(words, 3, 3) == [(0, 6, 2), (6, 3, 1)]


def by_contract(doc_id, text):
    words = [w for w in (text or "").encode().split()]
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    digest = lambda x: hashlib.sha256(x).hexdigest()
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(runs), *best, milli, digest("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()), digest(b" ".join(collapsed(words, runs))))


def test_query_digests(spark):
    rng = random.Random(2)
    rows = [(i, random_text(rng)) for i in range(300)] + [(300, None), (301, ""), (302, " \n "), (303, "é " * 9 + "x\x1cy " * 7), (303, "é " * 9 + "x\x1cy " * 7)]
    rows += [(400 + i, " ".join(f"w{rng.randrange(50)}" for _ in range(400))) for i in range(40)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, runs string")
    got = periodic.digests(periodic.periodic_runs(frame, periodic.planted))
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, (by_contract(*r) for r in rows)))
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 20
    assert periodic.periodic_runs(frame.limit(0)).count() == 0


def test_rows_without_id_and_long_texts(spark):
    words = [f"w{i}" for i in range(40_000)]
    long = " ".join(words * 5)
    frame = spark.createDataFrame([(None, long), (None, "a a a a a a a"), (7, "ba " * 300_000)], "doc_id long, text string")
    got = {(r["doc_id"], r["strongest"]["length"]): r for r in periodic.periodic_runs(frame).collect()}
    assert {k: [tuple(x) for x in r["runs"]] for k, r in got.items()} == {(None, 200_000): [(0, 200_000, 40_000)], (None, 7): [(0, 7, 1)], (7, 300_000): [(0, 300_000, 1)]}
    assert got[7, 300_000]["collapsed"] == "ba" and got[None, 200_000]["collapsed"] == " ".join(words)
