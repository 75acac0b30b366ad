"""The training sample holds every language."""

import random

from talewarp.llm import langid


def test_a_rare_language_is_trained_on(spark):
    rng = random.Random(1)
    words = {"aa": ["bada", "gado", "dabo"], "bb": ["xyku", "zuxy", "kyzu"], "rare": ["mlenn", "nolme", "lemno"]}
    rows = [(i, " ".join(rng.choices(words[lang], k=8)), lang) for i in range(6000) for lang in [("rare" if i % 1000 == 7 else "aa" if i % 3 else "bb")]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, train_rows=200)
    assert model.languages == ["aa", "bb", "rare"]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, model).collect()}
    assert all(got[i] == lang for i, _, lang in rows)


def test_of_many_labels_the_most_frequent_are_learned(spark):
    rows = [(i, f"word{i % 300} {chr(0x4E00 + i % 300)}", f"l{i % 300:03d}") for i in range(1500)] + [(i, "abc abc", "many") for i in range(2000, 2300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert len(model.languages) == langid.MAX_LANGUAGES and "many" in model.languages
    assert langid.predict(docs.where("lang = 'many'"), model).where("lang_pred = 'many'").count() == 300
    few = langid.train(docs, max_languages=1, train_rows=50)
    assert few.languages == ["many"] and langid.keep_identified(docs, max_languages=1).count() == 1800


def test_quotas():
    assert langid.quotas({"a": 1000, "b": 3, "c": 500}, 100) == {"b": 3, "c": 48, "a": 49}
    assert langid.quotas({"a": 5, "b": 3}, 100) == {"a": 5, "b": 3}
    assert langid.quotas({}, 100) == {}


def test_no_share_is_empty():
    assert langid.hash_limit(1.0) == (1 << 63) - 1 and langid.hash_limit(1e-30) == 1
    assert abs(langid.hash_limit(20_000 / 1e12) / 2**63 - 2e-8) < 1e-12


def test_scores_equal_a_plain_naive_bayes(spark):
    """Counts in dictionaries, one n-gram at a time, against the hashed matrix of numpy."""
    import math
    import zlib
    from collections import Counter

    rng = random.Random(5)
    texts = [(i, " ".join("".join(rng.choice("aábcd" if lang == "x" else "bcdeé") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 9))), lang) for i in range(150) for lang in ["x" if i % 3 else "y"]]
    odd = [(150, "", "x"), (151, None, "x"), (152, "12 - 3", "y"), (153, "Áb", None), (None, "bcd", "x"), (1, texts[1][1], "x"), (1, texts[1][1], "x")]
    docs = spark.createDataFrame([(i, t, lang, 0.5) for i, t, lang in texts + odd], "doc_id long, text string, lang string, score double")

    def grams(text):
        padded = f" {text.lower()} "
        for n in langid.ORDERS:
            for at in range(len(padded) - n + 1):
                h = n
                for c in padded[at : at + n]:
                    h = ((h * 0x9E3779B1 & 0xFFFFFFFF) ^ ord(c)) * 0x85EBCA6B & 0xFFFFFFFF
                yield (h >> 7) % langid.BUCKETS

    used = [(t, lang) for i, t, lang in texts + odd if i is not None and t is not None and lang and zlib.crc32(str(i).encode()) % 5]
    counts = {lang: Counter(g for t, own in used if own == lang for g in grams(t)) for lang in "xy"}
    size = {lang: sum(c.values()) + 0.5 * langid.BUCKETS for lang, c in counts.items()}
    prior = {lang: sum(own == lang for _, own in used) / len(used) for lang in "xy"}
    want = {}
    for _, text, _ in texts + odd:
        if text and any(c.isalpha() for c in text):
            logs = {lang: math.log(prior[lang]) + sum(math.log((counts[lang][g] + 0.5) / size[lang]) for g in grams(text)) for lang in "xy"}
            best = max(sorted(logs), key=logs.get)
            want[text] = (best, 1 / sum(math.exp(v - logs[best]) for v in logs.values()))
        else:
            want[text] = ("und", 0.0)
    got = langid.identify(docs)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == len(texts) + len(odd)
    text_of = {i: t for i, t, _ in texts + odd}
    for r in got.collect():
        lang, score = want[text_of[r["doc_id"]]]
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-3
