"""Table, requests, engine and forward ingestion together."""

import json
import os
from datetime import UTC, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from talewarp.operators import hybrid, summaries, tree, vector
from talewarp.operators import text as fulltext
from talewarp.operators.filters import Filter, InvalidRequest, parse_bound
from talewarp.plans import model, sql
from talewarp.plans.engine import REQUIRED, Engine, InvalidResult, checked, tool_request
from talewarp.plans.requests import choose_mode, decode
from talewarp.schema import CHUNK
from talewarp.streaming import forward
from talewarp.streaming.forward import ForwardIngest, KeyedState
from talewarp.table import ChunkTable, HashEmbedder, InvalidChunks
from talewarp.versions import Conflict


def chunk(number, content=None, **more):
    row = {f.name: None for f in CHUNK.fields} | {"Id": f"{number:02x}id", "Content": content or f"text {number}", "ChunkType": "turn", "SessionId": "s", "ProjectPath": "/p", "ProjectName": "p", "Timestamp": datetime(2026, 1, 1, tzinfo=UTC), "SourceFile": "f", "SourceLine": number}
    return tuple((row | more)[f.name] for f in CHUNK.fields)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), CHUNK)


def test_table(spark, tmp_path):
    table, embedder = ChunkTable(spark, str(tmp_path / "t"), 16), HashEmbedder(16)
    table.initialize()
    table.initialize()
    assert table.upsert(frame(spark, chunk(1), chunk(2, MachineId="m"), chunk(2, "later", MachineId="m"))) == 2
    assert {r["Id"]: r["Content"] for r in table.read().collect()} == {"01id": "text 1", "02id": "later"}
    report = {r["shard"]: r["processed"] for r in table.backfill(embedder).collect()}
    assert report == {"01": 1, "02": 1} and table.read().where("Vector IS NULL").count() == 0
    table.upsert(frame(spark, chunk(1), chunk(2, "changed")))
    assert {r["Id"]: r["Vector"] is None for r in table.read().collect()} == {"01id": False, "02id": True}
    for bad in (chunk(3, ChunkType="x" * 40), chunk(3, SourceLine=-1), chunk(3, Vector=[0.0] * 16), chunk(3, Vector=[1.0])):
        with pytest.raises(InvalidChunks):
            table.upsert(frame(spark, chunk(4), bad))
    table.upsert(frame(spark, chunk(5, MachineId="m")))
    assert table.delete_machine(" m ") == 1 and table.delete_machine("m") == 0
    assert table.optimize() is False and table.stats(0.0)["total"] == 2
    assert table.clear() == 2 and table.read().count() == 0


def test_states_survive_writers_that_die_or_meet(spark, tmp_path):
    table = ChunkTable(spark, str(tmp_path / "t"), 16, buckets=4)
    table.initialize()
    table.upsert(frame(spark, chunk(1), chunk(2)))
    before = table.version()
    # a writer died between making the state's file and filling it
    dead = tmp_path / "t" / "states" / f"{before + 1:020d}"
    dead.touch()
    os.utime(dead, (1, 1))
    assert {r["Id"] for r in table.read().collect()} == {"01id", "02id"}
    table.upsert(frame(spark, chunk(3)))
    assert table.version() == before + 2 and table.read().count() == 3
    # another commits while this one writes: it starts again from the newer state
    other, write, tries = ChunkTable(spark, str(tmp_path / "t"), 16), table._write, []

    def late(*args):
        if not tries:
            other.upsert(frame(spark, chunk(4), chunk(1, "theirs")))
        tries.append(args[0])
        write(*args)

    table._write = late
    table.upsert(frame(spark, chunk(1, "mine"), chunk(5)))
    assert len(tries) == 2
    assert {r["Id"]: r["Content"] for r in table.read().collect()} == {"01id": "mine", "02id": "text 2", "03id": "text 3", "04id": "text 4", "05id": "text 5"}
    assert [r["Content"] for r in table.lookup(["05id"]).collect()] == ["text 5"]
    with pytest.raises(Conflict):
        table.versions.commit(0, {})
    table.vacuum()
    assert table.read().count() == 5
    rows = frame(spark, chunk(7, "second"), chunk(7, "first")).withColumn("at", F.when(F.col("Content") == "first", 1).otherwise(2))
    table.upsert(rows, order="at")
    assert table.lookup(["07id"]).first()["Content"] == "second"


def test_refused_texts_are_reported(spark, tmp_path):
    class Picky(HashEmbedder):
        def embed(self, texts, task="RETRIEVAL_DOCUMENT"):
            if any("bad" in t for t in texts):
                raise ValueError("refused")
            return super().embed(texts, task)

    table = ChunkTable(spark, str(tmp_path / "t"), 16)
    table.initialize()
    table.upsert(frame(spark, chunk(1), chunk(2, "bad"), chunk(3)))
    report = {r["shard"]: (r["processed"], r["failed"]) for r in table.backfill(Picky(16)).collect()}
    assert report == {"01": (1, 0), "02": (0, 1), "03": (1, 0)}
    assert {r["Id"] for r in table.read().where("Vector IS NULL").collect()} == {"02id"}


def test_indexes_follow_every_write(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector, "BUILD_THRESHOLD", 20)
    words = ["parser", "lexer", "token", "stack", "heap"]

    def some(numbers, seed):
        own = np.random.default_rng(seed)
        return [chunk(n, " ".join(own.choice(words, 6)), Id=f"{n:04x}", Vector=[float(x) for x in own.normal(size=16)]) for n in numbers]

    table = ChunkTable(spark, str(tmp_path / "t"), 16, buckets=4)
    table.initialize()
    table.upsert(frame(spark, *some(range(60), 1)))
    engine = Engine(table, HashEmbedder(16))
    assert engine.optimize(4)
    table.upsert(frame(spark, *some(range(50, 70), 2)))  # replaces ten, adds ten
    table.upsert(frame(spark, chunk(99, "lexer lexer", Id="0063", MachineId="m", Vector=[1.0] * 16)))
    table.delete_machine("m")
    again = ChunkTable(spark, str(tmp_path / "t"), 16)
    for t in (table, again):
        rows = t.read()
        entries, centres = t.leaves()
        assert sorted((r["Id"], tuple(r["Vector"])) for r in entries.collect()) == sorted((r["Id"], tuple(r["Vector"])) for r in rows.collect())
        assert len(centres) == 4
        for query in ("parser lexer", "heap", "nothing", "!"):
            want = [(r["Id"], round(r["Score"], 9)) for r in fulltext.bm25_topk(rows, query, 7).collect()]
            assert [(r["Id"], round(r["Score"], 9)) for r in t.search_text(query, 7).collect()] == want
            kept = F.col("SourceLine") < 30
            want = [(r["Id"], round(r["Score"], 9)) for r in fulltext.bm25_topk(rows, query, 7, kept).collect()]
            assert [(r["Id"], round(r["Score"], 9)) for r in t.search_text(query, 7, kept).collect()] == want
    assert engine.search('{"query": "parser", "use_hybrid": false}')["search_type"] == "ann"
    assert engine.search('{"query": "parser lexer"}')["search_type"] == "hybrid"


def test_block_search_reads_few_postings(spark, tmp_path):
    """Equal to scoring every document, while at most a fifth of a frequent token's postings are read."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select(F.col("doc_id").alias("Id"), F.col("text").alias("Content"))
    rows = fulltext.numbered(docs.withColumn("bucket", F.pmod(F.xxhash64("Id"), F.lit(4)).cast("int")))
    fulltext.posting_blocks(rows).repartition("token").sortWithinPartitions("token", F.desc("density")).write.parquet(str(tmp_path / "blocks"))
    index = spark.read.parquet(str(tmp_path / "blocks"))
    stats = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    every = {r["token"]: r["n"] for r in index.where(F.col("token").isin("the", "and", "of", "le")).groupBy("token").agg(F.sum("n").alias("n")).collect()}
    for query, k, most in (("the", 10, 0.2), ("the and", 10, 0.2), ("the and of", 5, 0.2), ("the le", 10, 1.0), ("the nowhere", 10, 1.0)):
        search = fulltext.BlockSearch(index, stats, query, k)
        want = [(r["Id"], round(r["Score"], 9)) for r in fulltext.bm25_topk(docs, query, k).collect()]
        assert [(r["Id"], round(r["Score"], 9)) for r in search.top().collect()] == want
        if not search.empty:
            read = {r["token"]: r["n"] for r in search.blocks().groupBy("token").agg(F.sum("n").alias("n")).collect()}
            shares = {t: n / every[t] for t, n in read.items()}
            assert shares["the"] <= most, (query, shares)
            plan = search.blocks()._jdf.queryExecution().executedPlan().toString()
            assert "GreaterThanOrEqual(density" in plan or search.least_density("the") == 0
    kept = docs.where("Id % 7 = 3").select("Id")
    want = [r["Id"] for r in fulltext.bm25_topk(docs, "the and", 10, F.col("Id") % 7 == 3).collect()]
    assert [r["Id"] for r in fulltext.BlockSearch(index, stats, "the and", 10, kept).top().collect()] == want


def test_ann_recall(spark):
    """Against brute force, over queries with ids divisible by 20, at both settings that are used."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    table = rows.toPandas().sort_values("vec_id")
    ids, x = table.vec_id.to_numpy(), np.stack(table.embedding).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for leaves, probes in ((vector.SMALL_LEAVES, vector.SMALL_PROBES), (400, vector.probes_for(400))):
        index, centres = vector.build_index(rows, leaves, stored=("vec_id", "label"), vector="embedding")
        leaf = index.select("vec_id", "leaf").toPandas().set_index("vec_id").leaf.loc[ids].to_numpy()
        hits = total = 0
        for q in np.flatnonzero(ids % 20 == 0)[:500]:
            scores = x @ x[q]
            near = np.isin(leaf, vector.nearest_leaves(centres, x[q], probes))
            want = set(np.argsort(-scores, kind="stable")[:10])
            hits += len(want & set(np.flatnonzero(near)[np.argsort(-scores[near], kind="stable")[:10]]))
            total += 10
        assert hits / total >= 0.9, (leaves, probes, hits / total)


def test_tree_recall(spark, tmp_path):
    """Over ids divisible by 20: recall 0.9 while the vectors of a tenth of the rows are read."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    model = tree.train(rows, 64, id_col="vec_id", vector="embedding")
    model.save(spark, str(tmp_path / "tree"))
    again = tree.Tree.load(spark, str(tmp_path / "tree"))
    assert all(np.array_equal(getattr(model, x), getattr(again, x)) for x in ("branches", "leaves", "branch_of", "codes")) and 40 <= len(model) <= 80
    index = tree.assigned(rows, model, ("vec_id", "label"), "embedding").cache()
    local = index.toPandas().sort_values("vec_id").reset_index(drop=True)
    x = np.stack(local.embedding).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    leaf, codes = local.leaf.to_numpy(), np.stack([np.frombuffer(c, np.uint8) for c in local.code])
    assert [tuple(map(np.ndarray.tolist, model.assign(x[:50])))] == [(leaf[:50].tolist(), codes[:50].tolist())]
    read = len(x) // 10
    hits = total = 0
    for q in np.flatnonzero(local.vec_id % 20 == 0):
        near = np.flatnonzero(np.isin(leaf, model.visit(x[q], tree.VISITED)))
        weights = np.einsum("mkw,mw->mk", model.codes, tree.padded(x[q][None], model.codes)[0])
        score = (model.leaves @ x[q])[leaf[near]] + weights[np.arange(len(model.codes)), codes[near]].sum(axis=1)
        best = near[np.argsort(-score, kind="stable")[:read]]
        if q < 60:  # Spark ranks the codes alike
            own = tree.candidates(index, model, x[q].tolist(), read, id_col="vec_id")
            got = {r["vec_id"] for r in own.collect()}
            assert len(got ^ set(local.vec_id[best])) <= 2 and not {"embedding"} & set(own.columns)
        want = set(np.argsort(-(x @ x[q]), kind="stable")[:10])
        hits += len(want & set(best[np.argsort(-(x[best] @ x[q]), kind="stable")[:10]]))
        total += 10
    assert hits / total >= 0.9, hits / total
    top = tree.topk(index, model, x[0].tolist(), 10, where=F.col("label") == 3, vector="embedding", id_col="vec_id").collect()
    exact = vector.exact_topk(rows, x[0].tolist(), 10, F.col("label") == 3, "embedding", "vec_id").collect()
    assert len({r["vec_id"] for r in top} & {r["vec_id"] for r in exact}) >= 7 and all(r["label"] == 3 for r in top)


def test_results_are_checked():
    good = {name: "x" for name in REQUIRED} | {"distance": 0.5}
    assert checked([good]) == [good] and checked([]) == []
    for bad in ({"content": ""}, {"distance": float("nan")}, {"distance": None}, {"timestamp": None}):
        with pytest.raises(InvalidResult):
            checked([good | bad])


def test_requests():
    assert decode('{"query": "x"}', "search").limit == 5
    for body, kind in (('{"query": " "}', "search"), ('{"query": "x", "limit": 51}', "search"), ('{"query": "x", "query": "y"}', "search"), ('{"query": "x", "other": 1}', "search"), ('{"operation": "delete"}', "files"), ("[]", "sessions")):
        with pytest.raises(InvalidRequest):
            decode(body, kind)
    assert decode('{"file_path": "a"}', "files").query == "file changes to a"
    assert parse_bound("2024-01-02", end=True) == datetime(2024, 1, 2, 23, 59, 59, 999999, tzinfo=UTC)
    assert parse_bound("2024-01-02T01:00:00+01:00") == datetime(2024, 1, 2, tzinfo=UTC)
    with pytest.raises(InvalidRequest):
        Filter(date_from=datetime(2024, 1, 2), date_to=datetime(2024, 1, 1)).validate()
    assert choose_mode("auto", Filter(session_id="s"), True) == "ann" and choose_mode("auto", Filter(operation="edit"), True) == "exact"
    with pytest.raises(InvalidRequest):
        choose_mode("ann", Filter(file_path="x"), True)
    assert summaries.progress((10, 0.0), 70, 60, 60.0) == {"rate_per_minute": 60.0, "eta_seconds": 60.0}


def test_sql_functions_equal_the_operators(spark):
    words = ["parser", "lexer", "token", "stack"]
    own = np.random.default_rng(3)
    rows = [chunk(n, " ".join(own.choice(words, 5)), Id=f"{n:04x}", SessionId=f"s{n % 7}", ProjectPath=f"/p{n % 3}", Timestamp=datetime(2026, 1, 1 + n % 5, tzinfo=UTC), Vector=[float(x) for x in own.normal(size=4)] if n % 4 else None) for n in range(60)]
    chunks = frame(spark, *rows)
    sql.register(chunks)
    sql.register(chunks)
    near, kept = [0.1, 0.2, -0.3, 1.0], F.col("ProjectPath") == "/p1"
    bound = {"near": F.array(*map(F.lit, near)), "words": "parser stack", "project": "/p1"}

    def rounded(found):
        return [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in found.collect()]

    said = lambda k, where=None: fulltext.bm25_topk(chunks, "parser stack", k, where)
    assert rounded(spark.sql("SELECT * FROM exact_search(:near, 6, :project) ORDER BY Distance, Id", args=bound)) == rounded(vector.exact_topk(chunks, near, 6, kept).select("Id", "Distance"))
    assert rounded(spark.sql("SELECT * FROM text_search(:words, 6, :project) ORDER BY Score DESC, Id", args=bound)) == rounded(said(6, kept).select("Id", "Score"))
    fused = hybrid.fuse([hybrid.ranked(vector.exact_topk(chunks, near, 100), "Distance", "Id"), hybrid.ranked(said(100), F.desc("Score"), "Id")], 8)
    assert rounded(spark.sql("SELECT * FROM hybrid_search(:near, :words, 8) ORDER BY Distance, Id", args=bound)) == rounded(fused.select("Id", "Distance").orderBy("Distance", "Id"))
    latest = summaries.latest_per_session(chunks, 3, kept).select("SessionId", "Id", "Timestamp")
    assert rounded(spark.sql("SELECT * FROM latest_sessions(3, :project) ORDER BY Timestamp DESC, Id", args=bound)) == rounded(latest)
    odd = bound | {"project": "/p1' OR '1' = '1", "words": "x') OR true --"}
    assert spark.sql("SELECT * FROM exact_search(:near, 6, :project)", args=odd).count() == spark.sql("SELECT * FROM text_search(:words, 6)", args=odd).count() == 0


class Brittle(HashEmbedder):
    """Gives a vector too few for calls with "short", and fails on "bad"."""

    def embed(self, texts, task="RETRIEVAL_DOCUMENT"):
        if "bad" in texts:
            raise ValueError("refused")
        return super().embed(texts, task)[: -1 if "short" in texts else None]


def test_model_as_a_table_function(spark):
    texts = {f"r{i:02d}": {7: "short", 12: "bad"}.get(i, f"text {i}") for i in range(23)}
    spark.createDataFrame([(k, v, 1) for k, v in texts.items()], "Id string, Content string, other int").coalesce(1).createOrReplaceTempView("texts_to_embed")
    model.register(spark, Brittle(8), "embed_some")
    found = spark.sql("SELECT * FROM embed_some(TABLE(SELECT * FROM texts_to_embed) WITH SINGLE PARTITION)")
    rows = {r["Id"]: r for r in found.collect()}
    assert set(rows) == set(texts) and found.columns == ["Id", "Vector", "Error"]
    failed = {k: r["Error"] for k, r in rows.items() if r["Vector"] is None}
    assert set(failed.values()) == {"refused", "4 vectors for 5 texts"} and len(failed) == 10
    want = dict(zip(texts, HashEmbedder(8).embed(list(texts.values())), strict=True))
    assert all(np.allclose(r["Vector"], want[k]) and r["Error"] is None for k, r in rows.items() if k not in failed)
    dealt = spark.sql("SELECT count(*) AS n, count(Vector) + count(Error) AS told FROM embed_some(TABLE(SELECT * FROM texts_to_embed) PARTITION BY pmod(hash(Id), 4))").first()
    assert tuple(dealt) == (23, 23)
    with pytest.raises(Exception, match="Id and Content"):
        spark.sql("SELECT * FROM embed_some(TABLE(SELECT other FROM texts_to_embed))")
    with pytest.raises(ValueError, match="1 to 5"):
        model.register(spark, Brittle(8), batch=6)


def test_tool_arguments():
    assert tool_request("search_conversations", {"query": "x", "project_filter": "/p", "date_from": None, "limit": 3.0}) == {"query": "x", "project_path": "/p", "limit": 3}
    assert tool_request("search_file_changes", {}) == {"query": "file changes modifications edits"}
    assert tool_request("search_file_changes", {"file_path": "a", "operation_filter": "edit"}) == {"file_path": "a", "operation": "edit"}
    assert tool_request("get_session_summary", {"session_id": "s", "count": 20}) == {"session_id": "s", "limit": 20}
    for name, bad in (("search_conversations", {"query": "x", "limit": 51}), ("search_conversations", {"query": "x", "limit": 1.5}), ("search_conversations", {"query": "x", "use_hybrid": "yes"}), ("search_conversations", {"query": 3}), ("search_file_changes", {"operation_filter": "delete"}), ("get_session_summary", {"count": 21}), ("get_session_summary", {"count": True})):
        with pytest.raises(InvalidRequest):
            tool_request(name, bad)


def test_vectors_of_any_nullability_are_taken(spark, tmp_path):
    table = ChunkTable(spark, str(tmp_path / "t"), 2, buckets=2)
    table.initialize()
    rows = frame(spark, chunk(1)).withColumn("Vector", F.array(F.lit(1.0), F.when(F.col("SourceLine") == 1, 2.0)))
    assert table.upsert(rows) == 1 and table.read().first()["Vector"] == [1.0, 2.0]
    with pytest.raises(InvalidChunks, match="vector_not_finite"):
        table.upsert(rows.withColumn("Vector", F.array(F.lit(1.0), F.lit(None).cast("double"))))


def transcript(root, name, stamp, turns=1):
    rows = []
    for i in range(turns):
        rows.append({"type": "user", "uuid": f"u{i}", "sessionId": name, "timestamp": stamp, "message": {"content": f"question {i} about parsers"}})
        rows.append({"type": "assistant", "timestamp": stamp, "message": {"content": [{"type": "text", "text": f"answer {i}"}, {"type": "tool_use", "name": "Write", "input": {"file_path": f"/w/f{i}.py"}}]}})
    rows.append({"type": "summary", "summary": "we talked", "sessionId": name, "timestamp": stamp})
    root.mkdir(parents=True, exist_ok=True)
    (root / f"{name}.jsonl").write_text("\n".join(map(json.dumps, rows)))


def test_forward_and_search(spark, tmp_path):
    root, embedder = tmp_path / "projects" / "-w-app", HashEmbedder(32)
    table = ChunkTable(spark, str(tmp_path / "table"), 32)
    table.initialize()
    transcript(root, "old", "2020-01-01T00:00:00Z")
    ingest = ForwardIngest(spark, [str(tmp_path / "projects")], table, str(tmp_path / "state"), "mac", embedder)
    ingest.start()
    assert ingest.tick() == {"accepted": 0, "refused": 0, "waiting": 0}
    soon = (datetime.now(UTC) + timedelta(hours=1)).isoformat().replace("+00:00", "Z")
    transcript(root, "fresh", soon, 2)
    transcript(root, "late", "2021-01-01T00:00:00Z")
    assert ingest.tick() == {"accepted": 1, "refused": 1, "waiting": 0} and table.read().count() == 5
    again = ForwardIngest(spark, [str(tmp_path / "projects")], table, str(tmp_path / "state"), "mac", embedder)
    again.start()
    assert again.tick() == {"accepted": 0, "refused": 0, "waiting": 0} and table.read().count() == 5

    talk = [{"id": f"c{n}", "title": "T", "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a", "created_at": t}]} for n, t in enumerate(("2020-01-01T00:00:00Z", soon))]
    export = tmp_path / "projects" / "conversations.json"
    export.write_text(json.dumps(talk))
    assert again.tick()["accepted"] == 1
    assert [r["SessionId"] for r in table.read().where("ProjectName = 'ChatGPT'").collect()] == ["c1"]

    engine = Engine(table, embedder)
    found = engine.search('{"query": "question parsers", "limit": 3}')
    assert found["search_type"] == "hybrid" and "question" in found["results"][0]["content"]
    assert engine.search('{"query": "parsers", "use_hybrid": false, "limit": 2}')["search_type"] == "exact"
    changes = engine.search_files('{"file_path": "f1.py"}')
    assert [r["file_path"] for r in changes["results"]] == ["/w/f1.py"]
    assert engine.sessions("{}")["results"][0]["chunk_type"] == "summary"
    assert engine.search('{"query": "x", "project_path": "/none"}')["search_type"] == "empty"
    assert engine.status()["total"] == 6 and engine.ready() and not engine.ready(watcher_ready=False)


def test_a_tick_stops_at_its_budget(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(forward, "MAX_FILES", 1)
    root = tmp_path / "projects" / "-w-app"
    root.mkdir(parents=True)
    table = ChunkTable(spark, str(tmp_path / "table"), 8, buckets=2)
    table.initialize()
    ingest = ForwardIngest(spark, [str(tmp_path / "projects")], table, str(tmp_path / "state"), "mac")
    ingest.start()
    for name in ("one", "two"):
        transcript(root, name, (datetime.now(UTC) + timedelta(hours=1)).isoformat().replace("+00:00", "Z"))
    assert [ingest.tick(budget=0)["accepted"] for _ in range(3)] == [1, 1, 0]


def test_keyed_state(spark, tmp_path):
    state = KeyedState(spark, str(tmp_path / "q"), capacity=1)
    state.enqueue("a", "1", 0)
    state.enqueue("a", "1", 0)
    for key, value in (("a", "2"), ("b", "1")):
        with pytest.raises(ValueError):
            state.enqueue(key, value, 0)
    state.retry("a", 5)
    assert state.due(4, 5).count() == 0 and state.due(6, 5).first()["attempts"] == 1
    state.acknowledge("a")
    assert state.rows().count() == 0
    state.put("c", "x", 2)
    with pytest.raises(ValueError):
        state.put("c", "y", 1)
    assert state.rows().where(F.col("key") == "c").first()["value"] == "x"


def test_postings_of_many_buckets_are_made_in_one_shuffle(spark, monkeypatch):
    """However many buckets the texts want, the answer is that of the plain search, and postings stay in the task of their texts."""
    from talewarp import queries

    monkeypatch.setattr(queries.fulltext, "BUCKET_TOKENS", 2000)
    folder = "/root/testdata/sf0.001"
    assert queries.fulltext_block_topk(spark, folder).collect() == queries.fulltext_bm25_topk(spark, folder).collect()
    docs = queries.table(spark, folder, "documents").selectExpr("doc_id AS Id", "text AS Content", "int(doc_id % 30) AS bucket").repartition(30, "bucket")
    plan = queries.fulltext.posting_blocks(queries.fulltext.numbered(docs))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_pieces_of_buckets_answer_as_the_table(spark, tmp_path, monkeypatch):
    """Buckets that are dealt to many pieces: rows, vectors of unchanged texts, repeated ids, blocks and searches."""
    from talewarp.operators import text as fulltext
    from talewarp.table import ChunkTable, HashEmbedder

    monkeypatch.setattr(ChunkTable, "PIECE_BYTES", 2000)
    store = ChunkTable(spark, f"{tmp_path}/t", 8, buckets=2)
    store.initialize()
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    body = lambda i: " ".join(words[(i * k) % 8] for k in range(1, 4 + i % 9))
    rows = [(f"r{i}", body(i), HashEmbedder(8).embed([body(i)])[0]) for i in range(300)]
    fixed = "'turn' AS ChunkType, 's' AS SessionId, '/p' AS ProjectPath, 'p' AS ProjectName, 'f' AS SourceFile, timestamp'2024-01-01' AS Timestamp, 1 AS SourceLine, 'm' AS MachineId"
    frame = lambda found: spark.createDataFrame(found, "Id string, Content string, Vector array<float>").selectExpr("*", *fixed.split(", "))
    store.upsert(frame(rows))
    store.upsert(frame([(i, t if n % 2 else t + " omega", None) for n, (i, t, _) in enumerate(rows[:100])] + [("r0", "alpha again", None)]).coalesce(1))
    got = {r["Id"]: r for r in store.read().collect()}
    assert len(got) == 300 and got["r0"]["Content"] == "alpha again" and got["r2"]["Content"] == body(2) + " omega"
    assert all((got[f"r{n}"]["Vector"] is not None) == (n % 2 == 1 or n >= 100) for n in range(300))
    data = spark.read.parquet(*(f"{tmp_path}/t/data/{name}" for name in set(store.state()["buckets"].values())))
    assert data.groupBy("bucket", "block").count().where(f"count > {fulltext.BLOCK}").count() == 0 and data.where("block % 2 = 1").count() and data.where("block % 2 = 0").count()
    for query in ("alpha", "gamma theta"):
        want = [(r["Id"], round(r["Score"], 9)) for r in fulltext.bm25_topk(store.read(), query, 12).collect()]
        assert [(r["Id"], round(r["Score"], 9)) for r in store.search_text(query, 12).collect()] == want and want
