"""WARC, sharding, near-dedup, decontamination, top-k and the pipeline against brute force."""

import random

import duckdb
import numpy as np
import pytest
import xxhash

import corpus_pipeline
from talewarp.llm import decontam, queries, sharding, simhash, topk, warc

from .test_near import groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def sql(name):
    connection = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    cursor = connection.execute(queries.ORACLE_SQL[name])
    return [d[0] for d in cursor.description], cursor.fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    columns, want = sql(name)
    frame = queries.QUERIES[name](spark, SF)
    assert sorted(frame.columns) == sorted(columns)
    assert sorted(map(str, (tuple(r) for r in frame.select(columns).collect()))) == sorted(map(str, want))


def test_warc_round_trip(spark):
    long, short = "é" * 60, "short"
    pages = spark.createDataFrame([(5, "u", long), (3, None, long), (9, "u", long), (1, "u", short), (2, "u", short), (4, "u", None), (3, None, long), (None, "u", long), (6, "u\nv", "z" * 300_000)], "page_id long, url string, html string")
    rows = warc.round_trip(pages).collect()
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["record_type"], r["refers_to"]) for r in rows)
    assert got == sorted([("5", 120, "revisit", 3), ("3", 120, "response", None), ("9", 120, "revisit", 3), ("1", 5, "response", None), ("2", 5, "response", None), ("4", 0, "response", None), ("3", 120, "response", None), ("None", 120, "revisit", 3), ("6", 300_000, "response", None)])
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_archives_on_any_store(spark, tmp_path):
    """Archives are files of bounded size that any decoder reads; payloads come back whole."""
    import zstandard

    rng = random.Random(4)
    rows = [(i, f"http://h/{i}", "".join(rng.choice(["<p>", "é", "word ", "x" * rng.randrange(9)]) for _ in range(900)), i) for i in range(300)] + [(300, None, None, 1), (None, "u", "", 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest long")
    folder = f"file://{tmp_path}/warc"
    warc.write(pages, folder, archive_bytes=50_000)
    got = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read(spark, folder).collect()}
    assert got == {i: html or "" for i, _, html, _ in rows}
    files = sorted((tmp_path / "warc").glob("part-*.txt"))
    assert len(files) > 10 and max(f.stat().st_size for f in files) < 200_000
    data = files[0].read_bytes()
    size = int.from_bytes(data[4:8], "little")
    held = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
    plain = zstandard.ZstdDecompressor(dict_data=held).stream_reader(data, read_across_frames=True).read()
    assert plain.count(b"WARC/1.1\r\n") == len(list(warc.read_archive(data)))


def test_warc_records_of_others():
    import base64
    import hashlib

    import zstandard

    block = b"software: some crawler\r\n"
    digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
    head = f"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Block-Digest: sha1:{digest}\r\nContent-Length: {len(block)}\r\n\r\n".encode()
    pack = zstandard.ZstdCompressor().compress
    (row,) = warc.read_archive(pack(head + block + b"\r\n\r\n"))
    assert row["record_type"] == "warcinfo" and row["payload"] == block and row["page_id"] is None
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(pack(head + block.upper() + b"\r\n\r\n")))


def test_warc_reader_rejects_damage():
    import zstandard

    raw = warc.record(1, "u", b"payload", __import__("hashlib").sha256(b"payload").hexdigest(), None, False)
    samples = [random.Random(i).randbytes(400) * 3 + b"<html>common words</html>" * 20 for i in range(200)]
    dictionary = warc.train_dictionary(samples)
    held = zstandard.ZstdCompressionDict(dictionary)
    archive = warc.dictionary_frame(dictionary) + zstandard.ZstdCompressor(dict_data=held).compress(raw)
    assert [r["payload"] for r in warc.read_archive(archive)] == [b"payload"]
    pack = zstandard.ZstdCompressor().compress
    assert [r["page_id"] for r in warc.read_archive(pack(raw) * 2)] == [1, 1]
    for bad in (archive[:-3], pack(raw[:-1]), pack(raw.replace(b"payload\r", b"paylaod\r")), pack(raw.replace(b"WARC/1.1", b"WARC/9.9")), pack(raw.replace(b"WARC-Date", b"X-Date")), b"junk" + archive, pack(raw.replace(b"Content-Length: 7", b"Content-Length: 8"))):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(bad))


def test_shard_table():
    names = sharding.shard_names(7)
    table = sharding.lookup_table(names, 101)
    counts = np.bincount(table)
    assert counts.max() - counts.min() <= 1
    fewer = sharding.lookup_table(names[:-1], 101)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True))
    assert counts[-1] <= moved <= 60
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 100)


def test_shard_placement_edges(spark):
    rows = spark.createDataFrame([(1, "x"), (None, "y"), (1, "z")], "k long, slot string")
    got = sharding.place(rows, "k").collect()
    assert len(got) == 3 and len({r["shard"] for r in got if r["k"] == 1}) == 1 and all(r["shard"] for r in got)
    assert sharding.place(rows.limit(0), "k").count() == 0
    own = sharding.place(spark.createDataFrame([("a", 1, "q"), ("b" * 100_000, 2, None)], "slot string, `x.y` int, shard string"), "slot")
    assert own.columns == ["x.y", "slot", "shard"] and sorted(r["x.y"] for r in own.collect()) == [1, 2]


def fingerprint(text):
    words = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").replace("\t", " ").replace("\n", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def components(values):
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i][1] ^ values[j][1]).bit_count() <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups = {}
    for i, (doc, _) in enumerate(values):
        groups.setdefault(find(i), []).append(doc)
    return {doc: min(groups[find(i)]) for i, (doc, _) in enumerate(values)}


def test_simhash(spark, docs):
    odd = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(["", None, " \t", "One", "one two", "ONE TWO", "a\x0bb\x0cc d", "a b c d"])], "doc_id long, text string")
    frame = docs.select("doc_id", "text").unionByName(odd)
    values = sorted((r["doc_id"], fingerprint(r["text"])) for r in frame.collect())
    want = components(values)
    for hot in (simhash.HOT, 1):
        got = simhash.near_duplicates(frame, hot=hot).collect()
        assert {r["doc_id"]: r["fingerprint"] for r in got} == {d: f"{v:016x}" for d, v in values}
        assert {r["doc_id"]: r["component_id"] for r in got} == want
    kept = {r["doc_id"] for r in simhash.deduplicate(frame).collect()}
    assert kept == {d for d, c in want.items() if d == c}
    assert simhash.near_duplicates(frame.limit(0)).count() == 0


def test_simhash_links_chains_and_crowds(spark):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    crowd = [base ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(i)]
    chain = [rng.getrandbits(64)]
    for i in range(40):
        chain.append(chain[-1] ^ (1 << (i % 64)) ^ (1 << ((i * 7 + 1) % 64)))
    every = sorted({simhash._signed(v) for v in [*crowd, *chain, *(rng.getrandbits(64) for _ in range(100))]})
    from talewarp.llm.graph import components as connected

    frame = spark.createDataFrame([(v,) for v in every], "fp long")
    mask = (1 << 64) - 1
    want = components([(v, v & mask) for v in every])
    for hot in (8, 10_000):
        got = {r["node"]: r["label"] for r in connected(simhash.links(frame, hot=hot)).collect()}
        assert {v: got.get(v, v) for v in every} == want


def edited(words, rng, number):
    out = list(words)
    for _ in range(number):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = "zzq"
        elif kind == 1:
            out.pop(at)
        else:
            out.insert(at, "qqx")
    return out


def test_decontamination_recall_and_precision(spark, docs):
    rng = random.Random(5)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [r["text"] for r in docs.collect() if len(r["text"]) < 4000][:100]
    index = decontam.Index(items)
    for share, least in ((0.0, 1.0), (0.1, 0.98), (0.2, 0.9)):
        texts, want = [], []
        for item, text in items:
            words = decontam.words_of(text)
            around = decontam.words_of(rng.choice(clean))[:80]
            texts.append(" ".join([*around[:40], *edited(words, rng, int(share * len(words) + 1e-9)), *around[40:]]))
            want.append(item)
        found = index.find(texts)
        assert np.mean([any(w in index.ids[k] for k in m) for m, w in zip(found, want, strict=True)]) >= least
    brute = [decontam.words_of(t) for _, t in items]
    for text, matches in zip(clean, index.find(clean), strict=True):
        words = np.array(decontam.words_of(text) or [""])
        for k, item in enumerate(brute):
            distance = decontam.fitting_distance(np.array(item), words)
            if k in matches:
                assert distance <= decontam.allowed(len(item))
            elif distance == 0:
                raise AssertionError("an exact passage was missed")


def test_fitting_distance():
    def plain(item, text):
        row = [0] * (len(text) + 1)
        for i, a in enumerate(item):
            new = [i + 1]
            for j, b in enumerate(text):
                new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
            row = new
        return min(row)

    rng = random.Random(1)
    for _ in range(100):
        a, b = ([rng.randrange(3) for _ in range(rng.randrange(1, 9))] for _ in range(2))
        assert decontam.fitting_distance(np.array(a), np.array(b)) == plain(a, b)


def test_decontamination_edges(spark):
    text = "one two three four five six seven"
    benchmark = spark.createDataFrame([(1, text), (2, text), (3, None), (4, "too short"), (5, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"before {text.upper()} after", 7), (1, f"x {text}", 7), (2, None, 7), (3, "", 7), (None, text, 7), (4, "two one", 7)], "doc_id long, text string, item_id long")
    got = sorted((str(r["doc_id"]), r["item_id"], r["distance"]) for r in decontam.contaminated(docs, benchmark).collect())
    assert got == sorted([("1", 1, 0), ("1", 2, 0)] * 2 + [("None", 1, 0), ("None", 2, 0)])
    assert decontam.contaminated(docs.limit(0), benchmark).count() == 0 and decontam.decontaminate(docs, benchmark.limit(0)).count() == docs.count()
    kept = decontam.decontaminate(docs, benchmark, block_bytes=40)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "3", "4"]
    assert decontam.contaminated(docs, benchmark.limit(0)).count() == 0


def test_topk_edges(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(120)]
    rows += [(200 + i, rows[7][1]) for i in range(40)] + [(300, None), (301, [1.0, None]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (None, [1.0] * 6), (340, []), (40, rows[40][1]), (40, [3.0] * 6), (41, [2.0] * 6)]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, key string")
    whole = [(i, [int(np.floor(64 * x)) for x in v] + [0] * (6 - len(v))) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for at, (q, w) in enumerate(whole):
        if q is not None and q % 20 == 0:
            scores = sorted(((-int(np.dot(w, v)), i is None, i or 0) for n, (i, v) in enumerate(whole) if n != at))[:20]
            want += [(q, r + 1, None if missing else i, -s) for r, (s, missing, i) in enumerate(scores)]
    for options in ({"row_block": 3, "gather_blocks": 2}, {"slices": 3}):
        assert sorted(map(str, map(tuple, topk.search(frame, **options).collect()))) == sorted(map(str, want))
    assert topk.search(frame.where("vec_id IN (20, 21)")).count() == 1
    assert topk.search(frame.limit(0)).count() == 0


def test_topk_threshold_prunes_lists():
    rng = np.random.default_rng(3)
    x = rng.integers(-60, 60, (500, 8)) * rng.integers(1, 200, (500, 1))
    y = rng.integers(-60, 60, (9, 8))
    block = topk.Block(np.arange(500), np.arange(500), x, 2, 5)
    exact = y @ x.T
    order = np.argsort(-exact, axis=1, kind="stable")[:, :5]
    cutoff = np.take_along_axis(exact, order[:, 4:], axis=1)[:, 0].astype(float)
    read = []
    plain = block._list
    block._list = lambda s, y, upto: read.append(upto) or plain(s, y, upto)
    i, j, total = block.best(np.full(9, -1), y, cutoff)
    assert (total == exact[i, block.keys[j]]).all() and max(read) < 500
    for q in range(9):
        assert sorted(total[i == q].tolist()) == sorted(np.take(exact[q], order[q]).tolist())


def test_posting_tally(spark):
    """The index alone tells pairs that agree in six bytes or more."""
    assert len(simhash.blocks()) == 14
    rng = random.Random(9)
    base = rng.getrandbits(64)
    values = [base]
    for d in range(1, 6):
        for _ in range(8):
            values.append(base ^ sum(rng.randrange(1, 256) << (8 * p) for p in rng.sample(range(8), d)))
    frame = spark.createDataFrame([(simhash._signed(v),) for v in sorted(set(values))], "fp long")
    got = {(r["a"], r["b"]) for r in simhash.tallied(simhash.postings(frame)).collect()}
    mask = (1 << 64) - 1
    signed = sorted(simhash._signed(v) for v in set(values))
    want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if sum(((a ^ b) & mask) >> (8 * p) & 255 == 0 for p in range(8)) >= 6}
    assert got == want and want


def test_pipeline(spark):
    frame, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = frame.columns
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        frame = stage(spark, frame, SF)
        rows = frame.collect()
        kept.append({r["doc_id"] for r in rows})
        if number < len(corpus_pipeline.STAGES) - 1:
            assert frame.columns == columns, name
            frame = spark.createDataFrame(rows, frame.schema)
    assert all(after <= before for before, after in zip(kept, kept[1:], strict=False))
    assert kept[4] == kept[3] and len(kept[3]) > 100
    values = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r["doc_id"] in kept[1]]
    assert kept[2] == {d for d, c in groups(values).items() if d == c}
    held = decontam.contaminated(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert kept[3] == kept[2] - {r["doc_id"] for r in held.collect()}
