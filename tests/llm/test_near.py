"""The pipeline's near-dedup against all pairs."""

import random

import pytest

import corpus_pipeline
from talewarp.llm import common, graph, near, sharding, simhash

SF = "/root/testdata/sf0.001"


def groups(rows, least=near.SIMILARITY):
    def shingles(text):
        found = (text or "").encode().lower().split()
        return {b" ".join(found[i : i + near.SIZE]) for i in range(max(1, len(found) - near.SIZE + 1))} if found else set()

    def alike(a, b):
        return len(a & b) / len(a | b) if a or b else 1.0

    sets = [(d, shingles(t)) for d, t in rows]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            if alike(a, sets[j][1]) >= least:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    smallest = {}
    for i, (d, _) in enumerate(sets):
        smallest[find(i)] = min(d, smallest.get(find(i), d))
    return {d: smallest[find(i)] for i, (d, _) in enumerate(sets)}


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    word = [f"w{i}" for i in range(3000)]
    out = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for case in range(8):  # a crowd of near copies about each of some texts, edited in up to 5 words
        base = [rng.choice(word) for _ in range(120)]
        for _ in range(12):
            text = list(base)
            for _ in range(rng.randrange(6)):
                text[rng.randrange(len(text))] = rng.choice(word)
            out.append((100_000 + len(out), " ".join(text)))
    return out + [(200_000 + i, t) for i, t in enumerate(["", None, " \t", "One", "one", "one two", "a b c d e f"])]


@pytest.mark.parametrize("hot", [near.HOT, 48])
def test_near_copies_equal_all_pairs(spark, rows, hot):
    want = groups(rows)
    assert len(rows) - len(set(want.values())) > 60
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near.near_copies(frame, hot=hot).collect()} == want


def test_stage_drops_copies_with_a_few_edited_words(spark):
    rng = random.Random(11)
    base = [f"w{rng.randrange(3000)}" for _ in range(100)]
    edited = [*base[:30], "zzq", *base[31:70], "qqx", *base[71:]]
    docs = spark.createDataFrame([(1, " ".join(base), 7), (2, " ".join(edited), 7), (3, " ".join(reversed(base)), 7), (None, "no id", 7)], "doc_id long, text string, more long")
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "None"]
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), SF).count() == 0


def test_repeated_ids_keep_their_other_text(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long, 1), (2, long, 2), (2, "an other text of the same id", 3), (None, long, 4), (None, "no id", 5), (3, "no id", 6), (1, long, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` long")
    for stage in (near.deduplicate, simhash.deduplicate):
        kept = stage(docs)
        assert kept.columns == docs.columns and sorted(r["a.b"] for r in kept.collect()) == [1, 3, 6, 7]


def test_a_crowd_that_shares_a_passage_makes_few_pairs(spark, monkeypatch):
    """Documents that have a long passage in common, some with little else, and near copies among them."""
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(100)]
    rows = []
    for i in range(400):
        own = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([8, 11, 14, 18, 22, 26, 40, 120]))]
        cut = rng.randrange(len(own))
        text = own[:cut] + passage + own[cut:]
        rows.append((i, " ".join(text)))
        if i % 20 == 0:  # an edited copy
            text[rng.randrange(len(text))] = "edited"
            rows.append((1000 + i, " ".join(text)))
    want, compared, verified = groups(rows), [], near._verified
    monkeypatch.setattr(near, "_verified", lambda pairs, *more: compared.append(pairs.count()) or verified(pairs, *more))
    got = {r["doc_id"]: r["component_id"] for r in near.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and 20 < len(rows) - len(set(want.values())) < 400
    assert len(compared) == 3 and sum(compared) < 20 * len(rows) < len(rows) ** 2 / 10


def test_prefix_pairs_hold_all_similar_pairs(spark):
    """The prefix join alone, without buckets and components, against all pairs."""
    rng = random.Random(4)
    rows = []
    for i in range(60):
        base = [f"w{rng.randrange(40)}" if i % 2 else f"v{i} {j}" for j in range(rng.randrange(1, 60))]
        for _ in range(4):
            text = list(base)
            for _ in range(rng.randrange(4)):
                text[rng.randrange(len(text))] = f"x{rng.randrange(9)}"
            rows.append(near.hashed_shingles(" ".join(text).encode()))
    sets = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(rows)], "node long, hashes binary")
    crowd = sets.selectExpr("node", "node AS label")
    for least in (0.8, 0.5):
        found = {(r["a"], r["b"]) for r in near._prefix_pairs(crowd, sets, least).collect()}
        want = {(i, j) for j in range(len(rows)) for i in range(j) if near.similarity(rows[i], rows[j]) >= least}
        assert want <= found and len(want) > 60
    one = near._prefix_pairs(sets.selectExpr("node", "0L AS label"), sets, 0.8)
    assert one.count() == 0


def test_columns_of_any_name_are_kept(spark):
    frame = spark.createDataFrame([(1, "a b c", 1, 2, 3), (2, "a b c", 4, 5, 6)], "doc_id long, text string, dropped_id long, Dropped_Key long, _dropped_id long")
    for stage in (near.deduplicate, simhash.deduplicate):
        kept = stage(frame)
        assert kept.columns == frame.columns and [tuple(r) for r in kept.collect()] == [(1, "a b c", 1, 2, 3)]
    placed = sharding.place(spark.createDataFrame([(1, 2, 3, 4)], "doc_id long, place int, PLACE_ int, _slot int"), "doc_id")
    assert placed.columns == ["doc_id", "place", "PLACE_", "_slot", "slot", "shard"] and tuple(placed.first())[:4] == (1, 2, 3, 4)
    assert sharding.place(spark.createDataFrame([("k", 1)], "doc_id string, Slot int"), "doc_id").columns == ["doc_id", "slot", "shard"]


def test_labels_join_by_further_links(spark):
    links = lambda *pairs: spark.createDataFrame(list(pairs), "a long, b long")
    labels = graph.components(links((5, 6), (2, 3), (8, 9)))
    joined = graph.joined_labels(labels, links((6, 3), (1, 9), (20, 21), (2, 3)))
    assert {r["node"]: r["label"] for r in joined.collect()} == {2: 2, 3: 2, 5: 2, 6: 2, 8: 1, 9: 1, 1: 1, 20: 20, 21: 20}
    assert graph.joined_labels(labels, links((2, 3)).limit(0)).count() == 6


def test_fingerprints_go_through_the_tally(spark, monkeypatch):
    """Of members of one posting those with six positional bytes or more are candidates, and the stage takes them."""
    rng, prints = random.Random(5), []
    for _ in range(30):
        base = [rng.randrange(256) for _ in range(8)]
        for changed in (0, 0, 1, 2, 2, 3, 4, 4, 5):
            other = list(base)
            for place in rng.sample(range(8), changed):
                other[place] ^= rng.randrange(1, 256)
            prints.append(bytes(other))
    rows = [(i, 9, int.from_bytes(x, "little", signed=True), [i]) for i, x in enumerate(prints)]
    posted = near._posted(spark.createDataFrame(rows, "node long, size int, fp long, buckets array<long>"))
    found = near._alike_prints(posted.where(f"band >= {near.BANDS}")).collect()
    shared = lambda a, b: sum(x == y for x, y in zip(prints[a], prints[b], strict=True))
    want = {(a, b) for b in range(len(rows)) for a in range(b) if shared(a, b) >= 6}
    assert sorted(tuple(r) for r in found) == sorted(want) and len(want) > 100
    assert any(3 < shared(a, b) < 6 for b in range(len(rows)) for a in range(b))

    tally, calls = near.tallied, []
    monkeypatch.setattr(near, "tallied", lambda *a, **k: calls.append(1) or tally(*a, **k))
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, "an other text of some words")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()) == [1, 3] and calls


def test_tasks_follow_the_rows_not_the_shuffle_partitions(spark, rows, monkeypatch):
    """Of many shuffle partitions few get a task and files where there are few rows, though Spark joins none."""
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before, parts, whole = {k: spark.conf.get(k, None) for k in settings}, [], near.checkpointed

    def counted(df):
        parts.append((out := whole(df)).rdd.getNumPartitions())
        return out

    for module in (near, graph, simhash):
        monkeypatch.setattr(module, "checkpointed", counted)
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        frame = spark.createDataFrame(rows[-100:], "doc_id long, text string").coalesce(4)
        got = {r["doc_id"]: r["component_id"] for r in near.near_copies(frame).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    few = max(4, spark.sparkContext.defaultParallelism)
    assert got == groups(rows[-100:]) and len(parts) > 10
    assert sum(n > 2 * few for n in parts) <= 3, parts  # the links that each round of components begins with


def test_sized_holds_all_rows_in_no_more_partitions(spark):
    cores = spark.sparkContext.defaultParallelism
    for there, rows, each, want in ((64, 10, 100_000, cores), (64, 48 * 1000 - 1, 1000, max(48, cores)), (3, 10**9, 1000, 3)):
        frame = common.sized(spark.range(0, 5000, 1, there), rows, each)
        assert frame.rdd.getNumPartitions() == min(want, there) and frame.count() == 5000
