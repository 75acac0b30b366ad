"""Source divergence against plain counting, with odd rows and small blocks."""

import random
import re
from collections import Counter, defaultdict

import pytest

from talewarp.llm import divergence

COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def plain(rows, min_docs=3, top=200):
    of_group, of_doc = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        of_group[lang or "", source or ""].update(found)
        of_doc[lang or ""].update(set(found))
    out = []
    for lang in {k for k, _ in of_group}:
        kept = [t for t, n in of_doc[lang].items() if n >= min_docs]
        groups = {s: c for (k, s), c in of_group.items() if k == lang}
        whole = sum(groups.values(), Counter())

        def given(counts, kept=kept):
            total = sum(counts[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // total for t in kept}

        p = {s: given(c) for s, c in groups.items()}
        q = given(whole)
        for s in groups:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in groups if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                for rank, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


def odd_rows():
    rng = random.Random(3)
    words = ["The", "the", "ab", "Éa", "éa", "x1y", "日本", "z_z", "naïve", "Q"] + [f"w{chr(97 + i)}" for i in range(26)]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(60))), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", "", None, "é", "zz"] + [f"s{i}" for i in range(20)])) for _ in range(400)]
    rows += [("only once here", "xx", "a"), ("", "xx", "b"), (None, "yy", "alone"), ("same same", "zz", "a"), ("same", "zz", "b"), ("same", "zz", "b")]
    return rows + [("the " * 30_000, "en", "hot")] + [("the same hot line", "en", "hot")] * 300


@pytest.mark.parametrize(("groups", "terms"), [(2, 5), (64, 4096)])
def test_equals_plain_counting(spark, groups, terms):
    rows = odd_rows()
    frame = spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, source string, n long")
    got = divergence.audit(frame, top_terms=7, groups=groups, terms=terms)
    assert got.columns == COLUMNS
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, top=7)


def test_empty_table(spark):
    frame = spark.createDataFrame([], "text string, lang string, source string, block long")
    assert divergence.audit(frame).collect() == []


def test_shares_of_large_counts():
    import numpy as np

    times, total = np.array([1, 9 * 10**14, 10**15 + 7]), np.array([7 * 10**15, 9 * 10**14, 3 * 10**15])
    assert divergence.shares(times, total).tolist() == [1 + 10**9 * int(t) // int(m) for t, m in zip(times, total, strict=True)]
