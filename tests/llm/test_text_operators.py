"""Token counts, packing, language, toxicity and main text against plain computations."""

import zlib

import numpy as np
import pytest

from talewarp.llm import html_text, langid, packing, token_counts, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", None, "   \n\t ", "a<|endoftext|>b it's DON'T", "é é  x y ÀÉß", "漢字 かな 12 3.4", "word " * 3000, "x" * 5000, "İ ẞ Ω"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(ODD)] + [(None, "no id", None, None, None), (1, None, "en", "s", 0)], DOCS)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_counts.default_tokenizer_path())


def ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_token_counts_equal_the_library(spark, docs, odd, tokenizer):
    for frame in (docs, odd):
        got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(frame).collect())
        want = sorted((str(r["doc_id"]), len((r["text"] or "").encode()), n := len(ids(tokenizer, r["text"])), n > 2048) for r in frame.collect())
        assert got == want
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


def test_token_counts_of_long_texts(spark, monkeypatch, tokenizer):
    monkeypatch.setattr(token_counts, "SLICE_BYTES", 100)
    texts = ["some words, é and marks! " * 40, "x" * 300, "漢字" * 90, "\u3000".join(["wide"] * 60), " " * 250]
    frame = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens long")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(frame).collect()}
    assert got == {i: len(ids(tokenizer, t)) for i, t in enumerate(texts)}


def test_long_texts_split_at_white_space():
    text = ("some words " * 1000).encode()
    parts = list(token_counts.split_long(text, 1000))
    assert b"".join(parts) == text and max(map(len, parts)) <= 1000
    assert list(token_counts.split_long(b"x" * 50, 10)) == [b"x" * 50]
    enc = token_counts.encoder(token_counts.default_tokenizer_path())
    assert sum(int(enc.counts([p])[0]) for p in parts) == int(enc.counts([text])[0])


def test_unsafe_vocabularies_get_whole_texts(spark):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    frame = spark.createDataFrame([(1, "Hello  big world"), (2, None)], "doc_id long, text string")
    byte_bpe, pieces = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(frame, byte_bpe).collect()}
    assert got == {1: len(Tokenizer.from_file(byte_bpe).encode("Hello  big world", add_special_tokens=False).ids), 2: 0}
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(frame, pieces).collect()}
    assert got == {1: len(sentencepiece.SentencePieceProcessor(model_file=pieces).encode("Hello  big world")), 2: 0}


def test_packing_covers_every_piece(spark, docs, odd, tokenizer):
    frame = docs.unionByName(odd.where("doc_id IS NULL OR doc_id > 1").selectExpr("doc_id + 1000000 AS doc_id", "text", "lang", "source", "n_chars"))
    rows = packing.pack(frame).collect()
    want = []
    for r in frame.collect():
        all_ids = np.array([*ids(tokenizer, r["text"]), 0], "<u4")
        for k in range(-(-len(all_ids) // 2048)):
            part = all_ids[2048 * k : 2048 * (k + 1)]
            want.append((str(r["doc_id"]), k, 2048 * k, len(part), zlib.crc32(part.tobytes())))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(sequences) <= -(-sum(r["length"] for r in rows) // 2048) + 1


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_each_piece_once(seed):
    rng = np.random.default_rng(seed)
    histogram = np.zeros(65, np.int64)
    for length in rng.integers(1, 65, 30):
        histogram[length] += int(rng.integers(1, 200))
    planned = packing.plan(histogram, 64)
    used = np.zeros(65, np.int64)
    for lengths, number in planned:
        assert sum(lengths) <= 64 and number > 0
        for x in lengths:
            used[x] += number
    assert (used == histogram).all()
    best_fit = sum(n for _, n in packing._best_fit(histogram.copy(), 64))
    assert sum(n for _, n in planned) <= best_fit * 1.02 + 1
    assert packing.plan(np.zeros(65, np.int64), 64) == []


def test_patterns_are_all_there_is():
    got = {tuple(sorted(int(x) for x in r if x)) for r in packing.patterns(12, np.array([2, 3, 5, 7, 12]))}
    assert got == {(12,), (5, 7), (2, 3, 7), (2, 5, 5)}
    near = {tuple(sorted(int(x) for x in r if x)) for r in packing.patterns(2048, np.array([640, 700]), 64)}
    assert near == {(640, 700, 700)}


def test_patterns_fit_lengths_that_never_fill_a_sequence():
    histogram = np.zeros(2049, np.int64)
    histogram[640], histogram[700] = 1000, 2000
    rows = packing.patterns(2048, np.array([640, 700]), 64)
    assert abs(packing.fit_counts(rows, histogram)[0] - 1000) < 50
    planned = packing.plan(histogram)
    assert ((700, 700, 640), 1000) in planned or sum(n for p, n in planned if sorted(p) == [640, 700, 700]) >= 950
    assert sum(n for _, n in planned) <= 1020


def test_packing_edges(spark, monkeypatch):
    frame = spark.createDataFrame([(None, "same text", 1)] * 50 + [(7, "same text", 2), (8, None, 3)], "doc_id long, text string, length long")
    monkeypatch.setattr(packing, "PIECES_PER_SALT", 8)
    rows = packing.pack(frame).collect()
    assert len(rows) == 52 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 52
    assert packing.pack(frame.limit(0)).count() == 0
    monkeypatch.setattr(packing, "SLICE_BYTES", 64)
    long = spark.createDataFrame([(1, "some words " * 3000), (2, "x" * 500)], "doc_id long, text string")
    enc = token_counts.encoder(token_counts.default_tokenizer_path())
    got = {}
    for r in packing.pack(long).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == {1: int(enc.counts([b"some words " * 3000])[0]) + 1, 2: int(enc.counts([b"x" * 500])[0]) + 1}


def test_language(spark, docs, odd):
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    held = [(r["lang"], got[r["doc_id"]]["lang_pred"]) for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 20 and np.mean([a == b for a, b in held]) > 0.9
    assert all(got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in docs.collect())
    rows = langid.predict(odd, langid.train(docs)).collect()
    assert len(rows) == len(ODD) + 2 and all(r["lang_pred"] == "und" and r["score"] == 0 for r in rows if r["doc_id"] in (0, 1, 2))
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert langid.identify(docs.limit(0)).count() == 0
    kept = langid.keep_identified(docs.unionByName(odd)).select("text").collect()
    assert all(t["text"] and any(map(str.isalpha, t["text"])) for t in kept) and len(kept) > 190


def test_toxicity_held_out_accuracy(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{base}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    held = toxicity.score(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), model).where("held_out").join(labels, "doc_id").toPandas()
    assert (held.predicted == held.toxic).mean() > 0.98
    assert held[held.toxic == 1].predicted.mean() > 0.88
    plain, marked, spaced, clean, *_ = model.summary(["you are an idiot indeed", "you are an i.d.i-o.t! indeed", "you are an i d i o t indeed", "the stone is of the", "", "x"])[:, 0]
    assert plain == marked == spaced > 0.5 > clean
    extra = model.summary(["idxiot", "idiiot", "idot"])[:, 0]
    assert (extra > clean + 1).all()
    assert (model.scores(["the stone is of the", "", "x"]) < 0.5).all()


def test_language_of_long_texts_and_many_languages(monkeypatch):
    rng = np.random.default_rng(3)
    names = [f"l{i:02d}" for i in range(7)]
    logp = np.log(rng.random((512, len(names)))).astype(np.float32)
    texts = ["", "a", "ab cd", "word " * 300, "é" * 50, *("".join(rng.choice(list("abcde "), n)) for n in (1, 2, 3, 40, 900))]
    model = langid.Model(names, logp, np.log(np.full(len(names), 1 / len(names))))
    whole = langid._score(texts, model, (1, 2, 3))
    for cells in (7, 21, 350, 7000):
        monkeypatch.setattr(langid, "CELLS", cells)
        got = langid._score(texts, model, (1, 2, 3))
        assert got[0] == whole[0] and np.allclose(got[1], whole[1], atol=1e-4)


def test_toxicity_of_long_texts_in_parts():
    rng = np.random.default_rng(4)
    model = toxicity.Model(rng.normal(size=toxicity.FEATURES), -0.5)
    words = ["i", "d", "i.d", "idiot", "", "a\tb", "stone", "x y z", "é", "..", "the\n\n"]
    texts = [" ".join(rng.choice(words, n)) for n in (1, 5, 50, 400, 1500)] + ["", "x " * 300, "y" * 500]
    whole = model.summary(texts)
    for limit in (1, 7, 100, 900):
        for text in texts:
            assert " ".join(p.replace("\t", " ").replace("\n", " ") for p in toxicity._parts(text, limit)) == text.replace("\t", " ").replace("\n", " ")
        assert np.allclose(model.summary(texts, part_chars=limit), whole, atol=1e-5)


def test_toxicity_edges(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.detect(odd, labels).collect()
    assert len(rows) == len(ODD) + 2 and all(r["score"] == 0 and r["predicted"] == 0 for r in rows)


def test_kernel_equals_counting_every_subsequence():
    """Gap-weighted common subsequences of three characters, one by one, against features and margins."""
    from itertools import combinations

    def features(word):
        c = [toxicity.START, *(int(toxicity._classes()[ord(x)]) for x in word), toxicity.START]
        out = {}
        for i, j, k in combinations(range(len(c)), 3):
            if k - i + 1 <= toxicity.SPAN:
                out[c[i], c[j], c[k]] = out.get((c[i], c[j], c[k]), 0) + toxicity.DECAY ** (k - i + 1)
        scale = toxicity._scale()[min(len(word) + 2, toxicity.NORM_LENGTH)]
        return {f: v / scale for f, v in out.items()}

    words = ["idiot", "idxiot", "stone", "a", "ab", "mississippi", "été", "x1y2", "abcdefghijklmnop"]
    plain = [features(w) for w in words]
    want = np.array([[sum(v * b.get(f, 0) for f, v in a.items()) for b in plain] for a in plain])
    units = [bytes([toxicity.START, *(int(toxicity._classes()[ord(x)]) for x in w)]) for w in words]
    used = np.unique(toxicity._triples(units)[1])
    written = toxicity._written(units, used)
    assert np.allclose(written @ written.T, want)
    alpha = np.linspace(-1, 1, len(words))
    weights = np.zeros(toxicity.FEATURES)
    weights[used] = written.T @ alpha
    classes, starts, _ = toxicity._units([" ".join(words)])
    assert np.allclose(toxicity._margins(classes, starts, weights.astype(np.float32)), want @ alpha, atol=1e-5)


def test_toxicity_of_letters_in_other_forms(spark):
    model = toxicity.Model(np.random.default_rng(2).normal(size=toxicity.FEATURES), -0.5)
    plain, bold, wide, far = model.summary(["idiot", "\U0001d422\U0001d41d\U0001d422\U0001d428\U0001d42d", "\uff49\uff44\uff49\uff4f\uff54", "\U00020000\U00020001\U00020002"])
    assert np.allclose(plain, bold) and np.allclose(plain, wide) and not np.allclose(plain, far)


def test_toxicity_rows(spark):
    text = [("you are an idiot", 1), ("a fine stone house", 0)]
    rows = [(i, f"{text[i % 2][0]} {'abcdefgh'[i % 8]}", i) for i in range(120)] + [(None, "you are an idiot", 1), (7, None, 1), (7, "", 1), (8, "idiot " * 3000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    known = [(i, 0, text[i % 2][1]) for i in range(120)]
    labels = spark.createDataFrame([*known, *known[:20], (3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.detect(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    found = got.collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    assert np.mean([r["predicted"] == text[r["doc_id"] % 2][1] for r in found[:120]]) > 0.95
    assert toxicity.detect(docs.limit(0), labels).count() == 0
    kept = toxicity.remove_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in found)


def test_collapsed_weights_equal_the_kernel():
    units = [bytes(int(toxicity._classes()[ord(c)]) for c in f" {w}") for w in ("idiot", "idoit", "stone", "ixdixot")]
    used = np.unique(toxicity._triples(units[:2])[1])
    landmarks, alpha = toxicity._written(units[:2], used), np.array([0.7, -0.2])
    weights = np.zeros(toxicity.FEATURES)
    weights[used] = landmarks.T @ alpha
    assert np.allclose(toxicity._unit_scores(units, weights), toxicity._kernel(units, landmarks, used) @ alpha, atol=1e-5)


def test_main_text(spark):
    cases = {
        '<html><body><header>Site</header><div id="content"><h2>T</h2><p>One  two &amp; three<p>Four <b>bold</b><br>five<div class="sidebar">x<p>y</div><p>Six</div><div class="comments"><p>no</div><footer>f</footer>': "T\nOne two & three\nFour bold\nfive\nSix",
        '<div class="ad">open ad<article><p>a < b & c</p><aside>n</aside><p>d</article>': "a < b & c\nd",
        '<nav><a href="/">Home</a></nav><ul><li><a href="x">one</a></li></ul><p>Body text here.</p><form>q<input></form><script>if (a < b) "</p>"</script>': "Body text here.",
        "plain text only": "plain text only",
        "": "",
    }
    rows = spark.createDataFrame([(i, f"u{i}", h) for i, h in enumerate(cases)] + [(9, None, None)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_text.extract(rows).collect()}
    assert [got[i]["text"] for i in range(len(cases))] == list(cases.values())
    assert got[9]["text"] == "" and got[9]["n_chars"] == 0 and got[0]["n_chars"] == len(got[0]["text"])


def test_words_with_marks_and_words_asked_again_are_cheap(monkeypatch, tokenizer):
    """Marks after a plain word are encoded once a run of marks, and a full cache keeps what the last slices had."""
    monkeypatch.setattr(token_counts, "CACHE_WORDS", 40)
    enc, calls = token_counts.TextEncoder(token_counts.default_tokenizer_path()), []
    encode, tokenize = enc.encode, enc.tokenize
    enc.encode = lambda texts: calls.extend(texts) or encode(texts)
    enc.tokenize = lambda text: calls.append(text) or tokenize(text)
    common = " ".join(f"w{c}rd{end}" for c in "aeiouÉß" for end in ("", "###", "&&&"))
    slices = [f"{common} " + " ".join(f"own{chr(97 + k)}{chr(97 + i)}" for i in range(20)) for k in range(8)]
    odd = "don't x's. a<|endoftext|> b<c>, é## ż!! [É] 3a"
    for text in [*slices, odd, *slices]:
        flat, counts = enc.ids([text.encode()])
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert flat.tolist() == want and counts.tolist() == [len(want)]
    assert calls.count("###") == calls.count("&&&") == 1 and calls.count("ward") <= 3 and not any(x.endswith("rd###") for x in calls)
    assert len(enc.known) + len(enc.older) < 200
