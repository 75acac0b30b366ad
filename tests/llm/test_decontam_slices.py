"""Documents of one slice are matched each for itself."""

import random
import tracemalloc

import numpy as np
import pytest

from talewarp.llm import decontam

SF = "/root/testdata/sf0.001"


def plain(docs, items):
    """Smallest distance of every item and document, where it is allowed, by comparing all."""
    found = {}
    texts = [np.array(decontam.words_of(t or ""), object) for t in docs]
    for k, item in enumerate(items):
        words = decontam.words_of(item)
        for i, text in enumerate(texts):
            distance = decontam.fitting_distance(np.array(words, object), text)
            if distance <= decontam.allowed(len(words)):
                found[i, k] = distance
    return found


def matched(docs, items):
    index = decontam.Index(list(enumerate(items)))
    return {(i, item): d for i, m in enumerate(index.find(docs)) for k, (d, _) in m.items() for item in index.ids[k]}


def test_equals_comparing_all_on_documents(spark):
    docs = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = plain(docs, items)
    assert want and matched(docs, items) == want


@pytest.mark.parametrize(("share", "least"), [(0.0, 1.0), (0.05, 0.99), (0.1, 0.97), (0.2, 0.9)])
@pytest.mark.parametrize("alphabet", ["latin", "han"])
def test_recall_by_edits(share, least, alphabet):
    """Of the pairs that comparing all finds, at least this share is found; none else is."""
    rng = random.Random(share * 100)
    if alphabet == "latin":
        word, gap = [f"w{i}" for i in range(500)], " "
    else:
        word, gap = [chr(0x4E00 + i) for i in range(500)], ""
    items = [gap.join(rng.choice(word) for _ in range(rng.randrange(5, 50))) for _ in range(60)]
    docs = []
    for item in items:
        words = decontam.words_of(item)
        for _ in range(int(share * len(words) + 1e-9)):
            at = rng.randrange(len(words))
            words[at : at + rng.choice((0, 1))] = rng.choice(([], [rng.choice(word)]))
        docs.append(gap.join([*rng.choices(word, k=30), *words, *rng.choices(word, k=30)]))
    want, got = plain(docs, items), matched(docs, items)
    assert got.keys() <= want.keys() and all(got[x] >= want[x] for x in got)
    assert sum(x in got for x in want) >= least * len(want)


def test_items_of_common_words_take_bounded_memory(monkeypatch):
    """Thousands of items that differ in a word, on a text full of their common words."""
    rng = random.Random(5)
    items = [f"what is the capital of place{i}" for i in range(4000)]
    filler = ["what", "is", "the", "of", "capital"] + [f"w{i}" for i in range(200)]
    words = rng.choices(filler, k=60_000)
    for i in range(0, 4000, 400):
        words[10 * i : 10 * i] = f"what is the{' big' * (i % 800 == 0)} capital of place{i}".split()
    docs = [" ".join(words), "what is a capital of place7", "the capital of place9 is what"]
    want = {(0, i): int(i % 800 == 0) for i in range(0, 4000, 400)} | {(1, 7): 1}
    index = decontam.Index(list(enumerate(items)))
    tracemalloc.start()
    found = {(i, item): d for i, m in enumerate(index.find(docs)) for k, (d, _) in m.items() for item in index.ids[k]}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # a text may hold an item at a distance of one by chance, as any place may be missing
    assert {k: v for k, v in found.items() if k in want} == want and peak < 400e6, peak
    monkeypatch.setattr(decontam, "EXPANDED", 1000)
    monkeypatch.setattr(decontam, "CROWD", 10**9)
    again = decontam.Index(list(enumerate(items[:300])))
    few = {(i, item): d for i, m in enumerate(again.find(docs)) for k, (d, _) in m.items() for item in again.ids[k]}
    assert few == {k: v for k, v in found.items() if k[1] < 300}


def test_items_of_any_length_take_part():
    items = ["the quick brown fox", "北京是中国的首都", "ok", "!?!?", "", " ", "ภาษาไทย", "北"]
    docs = ["see The Quick, brown fox run", "我知道北京是中国的首都。", "北京是中国的都市", "what!?!?", "OK then", "quick brown fox", "เขียนภาษาไทยได้", None or ""]
    got = matched(docs, items)
    assert got == {(0, 0): 0, (1, 1): 0, (1, 7): 0, (2, 1): 1, (2, 7): 0, (3, 3): 0, (4, 2): 0, (6, 6): 0}


def test_long_texts_in_parts(monkeypatch):
    rng = random.Random(2)
    words = [f"w{rng.randrange(50)}" for _ in range(4000)]
    text, item = " ".join(words), " ".join(words[2000:2040])
    whole = decontam.Index([(1, item)]).find([text, "x" * 500])
    monkeypatch.setattr(decontam, "PART_CHARS", 64)
    assert decontam.Index([(1, item)]).find([text, "x" * 500]) == whole and whole[0][0][0] == 0 and whole[1] == {}


def test_a_match_stays_in_its_document():
    words = [f"word{i}" for i in range(20)]
    item, clean = " ".join(words), "nothing of the kind stands here"
    index = decontam.Index([(1, item)])
    for texts, want in (
        ([clean, item], [{}, {0: (0, 0)}]),
        ([clean, f"x y {item} z", clean], [{}, {0: (0, 2)}, {}]),
        (["", item, "", item], [{}, {0: (0, 0)}, {}, {0: (0, 0)}]),
        ([clean, " ".join(words[3:]), clean], [{}, {0: (3, 0)}, {}]),
        ([" ".join(words[:10]), " ".join(words[10:])], [{}, {}]),
    ):
        got = index.find(texts)
        assert [{k: d for k, (d, _) in m.items()} for m in got] == [{k: d for k, (d, _) in m.items()} for m in want]
