"""Registered queries of the engine on the driver's tables, with DuckDB equivalents.

``documents`` and ``embeddings`` joined by id stand in for chunks, ``events`` and
``conversations`` for ordered logs, ``pages`` for file paths.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import files, text
from .operators import hybrid, logs, summaries, tree, vector
from .operators import text as fulltext
from .plans import sql
from .session import scratch_folder, ship
from .sources import antigravity, claude, codex, common, exports, gemini

TEXT_QUERY, TOP, NEAR = "the and", 10, 100
CUTOFF = datetime(2024, 1, 8)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return [float(x) for x in table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]]


def _rounded(name: str) -> Column:
    return F.round(F.col(name), 6).alias(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


_DISTANCE = "round(1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6)"


@query(f"SELECT vec_id, label, {_DISTANCE} AS distance FROM embeddings WHERE embedding IS NOT NULL ORDER BY distance, vec_id LIMIT {TOP}")
def vector_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = vector.exact_topk(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), TOP, vector="embedding", id_col="vec_id")
    return top.select("vec_id", "label", F.round("Distance", 6).alias("distance"))


@query(f"SELECT vec_id, label, {_DISTANCE} AS distance FROM embeddings WHERE embedding IS NOT NULL AND label = 3 ORDER BY distance, vec_id LIMIT {TOP}")
def vector_exact_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = vector.exact_topk(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), TOP, F.col("label") == 3, "embedding", "vec_id")
    return top.select("vec_id", "label", F.round("Distance", 6).alias("distance"))


@query()
def vector_ann_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    index, centres = vector.build_index(rows, vector.SMALL_LEAVES, stored=("vec_id", "label"), vector="embedding")
    top = vector.ann_topk(index, centres, _query_vector(spark, sf_dir), TOP, vector.SMALL_PROBES, vector="embedding", id_col="vec_id")
    return top.select("vec_id", "label", F.round("Distance", 6).alias("distance"))


@query()
def vector_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a two-level index with product codes; vectors are read of 20 times ten rows only."""
    rows = table(spark, sf_dir, "embeddings")
    model = tree.train(rows, 64, id_col="vec_id", vector="embedding")
    folder = scratch_folder(spark, "tree")
    tree.assigned(rows, model, ("vec_id", "label"), "embedding").repartition("leaf").sortWithinPartitions("leaf").write.parquet(folder)
    top = tree.topk(spark.read.parquet(folder), model, _query_vector(spark, sf_dir), TOP, vector="embedding", id_col="vec_id")
    return top.select("vec_id", "label", F.round("Distance", 6).alias("distance"))


_WORDS = ", ".join(f"'{w}'" for w in fulltext.query_tokens(TEXT_QUERY))
_BM25 = f"""
tok AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS t FROM documents),
dl AS (SELECT doc_id, len(t) AS dl FROM tok),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
tf AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS token FROM tok) WHERE token IN ({_WORDS}) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
sc AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
       FROM tf JOIN df USING (token) JOIN dl USING (doc_id), st GROUP BY doc_id HAVING count(*) = {len(fulltext.query_tokens(TEXT_QUERY))})
"""


@query(f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM sc ORDER BY sc.score DESC, doc_id LIMIT {TOP}")
def fulltext_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = fulltext.bm25_topk(table(spark, sf_dir, "documents"), TEXT_QUERY, TOP, id_col="doc_id", text_col="text")
    return top.select(F.col("Id").alias("doc_id"), F.round("Score", 6).alias("score"))


@query(f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM sc ORDER BY sc.score DESC, doc_id LIMIT {TOP}")
def fulltext_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = fulltext.inverted_index(docs, "doc_id", "text")
    stats = docs.agg(F.count("*").alias("n"), F.avg(F.size(fulltext.tokens("text"))).alias("avgdl"))
    return fulltext.search_index(index, stats, TEXT_QUERY, TOP).select(F.col("Id").alias("doc_id"), F.round("Score", 6).alias("score"))


@query(f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM sc ORDER BY sc.score DESC, doc_id LIMIT {TOP}")
def fulltext_block_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From posting blocks that are stored and read again, of which a search opens those that can count."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("Id"), F.col("text").alias("Content"))
    folder = scratch_folder(spark, "blocks")
    dl = F.size(fulltext.tokens("Content"))
    row = docs.agg(F.count("*").alias("n"), F.avg(dl).alias("avgdl"), F.sum(dl).alias("tokens")).first()
    # a bucket's postings fit a task, and are written by the task that has its texts
    count = max(8, -(-(row["tokens"] or 0) // fulltext.BUCKET_TOKENS))
    dealt = docs.withColumn("bucket", F.pmod(F.xxhash64("Id"), F.lit(count)).cast("int")).repartition(count, "bucket")
    blocks = fulltext.posting_blocks(fulltext.numbered(dealt))
    blocks.sortWithinPartitions("token", F.desc("density")).write.parquet(folder)
    stats = spark.createDataFrame([row], "n long, avgdl double, tokens long")
    return fulltext.BlockSearch(spark.read.schema(blocks.schema).parquet(folder), stats, TEXT_QUERY, TOP).top().select(F.col("Id").alias("doc_id"), F.round("Score", 6).alias("score"))


@query(f"""WITH {_BM25},
v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY d, vec_id) - 1 AS rank FROM (
  SELECT vec_id, 1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS d
  FROM embeddings WHERE embedding IS NOT NULL AND vec_id IN (SELECT doc_id FROM documents) ORDER BY d, vec_id LIMIT {NEAR})),
t AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS rank FROM (SELECT * FROM sc ORDER BY score DESC, doc_id LIMIT {NEAR})),
f AS (SELECT id, sum(1.0::DOUBLE / (60 + rank + 1)) AS score FROM (FROM v UNION ALL FROM t) GROUP BY id)
SELECT f.id AS doc_id, lang, source, round(1 - least(1, score / (2.0::DOUBLE / 61)), 6) AS distance
FROM f JOIN documents ON doc_id = f.id ORDER BY score DESC, f.id LIMIT {TOP}""")
def hybrid_rrf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "Id").join(docs.select(F.col("doc_id").alias("Id")), "Id", "left_semi")
    near = vector.exact_topk(rows, _query_vector(spark, sf_dir), NEAR, vector="embedding")
    said = fulltext.bm25_topk(docs, TEXT_QUERY, NEAR, id_col="doc_id", text_col="text")
    top = hybrid.fuse([hybrid.ranked(near, "Distance", "Id"), hybrid.ranked(said, F.desc("Score"), "Id")], TOP)
    found = hybrid.late_materialized(top, docs.withColumnRenamed("doc_id", "Id"), ["lang", "source"])
    return found.select(F.col("Id").alias("doc_id"), "lang", "source", F.round("Distance", 6).alias("distance"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events WHERE event_type = 'click')
SELECT user_id, event_id, ts, value, 0.0::DOUBLE AS distance FROM r WHERE n = 1 ORDER BY ts DESC, event_id LIMIT 20""")
def latest_per_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = summaries.latest_per_session(table(spark, sf_dir, "events"), 20, F.col("event_type") == "click", "user_id", "ts", "event_id")
    return latest.select("user_id", "event_id", "ts", "value", F.col("Distance").alias("distance"))


@query("""SELECT count(*) AS total, count(embedding) AS embedded, count(*) - count(embedding) AS awaiting
FROM documents LEFT JOIN embeddings ON doc_id = vec_id""")
def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    return summaries.store_stats(docs.join(vectors, docs.doc_id == vectors.vec_id, "left"), "embedding")


@query("SELECT count(*) > 0 AS found FROM documents WHERE doc_id = 17")
def chunk_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(summaries.exists(table(spark, sf_dir, "documents"), 17, "doc_id"),)], "found boolean")


@query("SELECT page_id, url FROM pages WHERE url LIKE '%e_ample.net/%/1%'")
def filter_like_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.filters import Filter

    pages = table(spark, sf_dir, "pages").withColumnRenamed("url", "FilePath")
    return pages.where(Filter(file_path="e_ample.net/%/1").column()).select("page_id", F.col("FilePath").alias("url"))


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-06 23:59:59.999999' AND event_type = 'view'")
def filter_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.filters import Filter, parse_bound

    events = table(spark, sf_dir, "events").withColumnRenamed("ts", "Timestamp").withColumnRenamed("event_type", "ChunkType")
    start, end = (parse_bound(x, e).replace(tzinfo=None) for x, e in (("2024-01-05", False), ("2024-01-06", True)))
    wanted = Filter(chunk_type="view", date_from=start, date_to=end)
    return events.where(wanted.column()).select("event_id", F.col("Timestamp").alias("ts"))


@query("""WITH r AS (SELECT conv_id, turn, role, text FROM conversations WHERE role IN ('user', 'assistant')),
l AS (SELECT *, lag(role) OVER w AS before, lag(text) OVER w AS user_text, lag(turn) OVER w AS user_turn FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, user_turn, turn, user_text, text FROM l WHERE role = 'assistant' AND before = 'user'""")
def turn_pairing_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.paired_turns(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"]).select("conv_id", "user_turn", "turn", "user_text", "text")


@query("""WITH g AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS turn_group FROM conversations)
SELECT conv_id, turn_group::BIGINT AS turn_group, min(turn) AS first_turn, count(*) AS n,
       coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role <> 'user'), '') AS answer
FROM g WHERE turn_group > 0 GROUP BY ALL""")
def turn_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logs.turn_groups(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.col("role") == "user").where("turn_group > 0")
    answer = logs.joined_in_order(["turn"], F.when(F.col("role") != "user", F.col("text")))
    return rows.groupBy("conv_id", "turn_group").agg(F.min("turn").alias("first_turn"), F.count("*").alias("n"), answer.alias("answer"))


@query("""WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts END AS ts FROM events)
SELECT event_id, user_id, coalesce(last_value(ts IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING),
  first_value(ts IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS carried FROM e""")
def timestamp_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("ts", F.when(F.col("event_id") % 3 != 0, F.col("ts")))
    return events.select("event_id", "user_id", logs.carried_timestamp(events, "ts", ["user_id"], ["event_id"]).cast("timestamp_ntz").alias("carried"))


@query("""SELECT user_id, event_type, event_id, ts, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events) WHERE n = 1""")
def dedupe_last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return logs.last_wins(rows, ["user_id", "event_type"], ["event_id"])


@query("""SELECT conv_id, turn, left(sha256('In project demo, ' || role || ' said:' || chr(10) || text || conv_id::VARCHAR || turn::VARCHAR), 16) AS chunk_id FROM conversations""")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.concat(F.lit("In project demo, "), F.col("role"), F.lit(" said:\n"), F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.short_id(content, F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("chunk_id"))


#: Byte offsets of a text's characters, of blank lines, and of ends of sentences and lines; then the parts one after another.
_SPLIT = """WITH RECURSIVE c AS (SELECT doc_id, text, octet_length(encode(text)) AS size, string_split(text, '') AS chars FROM documents WHERE octet_length(encode(text)) > 8000),
x AS (SELECT doc_id, unnest(chars) AS ch, generate_subscripts(chars, 1) AS i FROM c),
y AS (SELECT doc_id, i, ch, lead(ch) OVER w AS after, sum(octet_length(encode(ch))) OVER w - octet_length(encode(ch)) AS place FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
t AS (SELECT doc_id, list(place::BIGINT ORDER BY i) AS places, coalesce(list(place::BIGINT) FILTER (ch = chr(10) AND after = chr(10)), []) AS blanks,
  coalesce(list(place::BIGINT + 2) FILTER (ch IN ('.', '!', '?') AND after = ' '), []) AS stops, coalesce(list(place::BIGINT + 1) FILTER (ch = chr(10)), []) AS ends FROM y GROUP BY doc_id),
d AS (SELECT c.doc_id, text, size, places || [size] AS places, blanks, stops, ends FROM c JOIN t ON t.doc_id = c.doc_id),
parts AS (
  SELECT doc_id, 0 AS part, 0::BIGINT AS a, {first} AS b FROM d
  UNION ALL
  SELECT doc_id, part + 1, a, {next} AS b FROM (
    SELECT p.doc_id, p.part, d.* EXCLUDE (doc_id), list_min(list_filter(d.places, lambda o: o >= greatest(p.a + 1, p.b - 1500))) AS a FROM parts p JOIN d ON d.doc_id = p.doc_id WHERE p.b < d.size))"""
_BEGIN = "greatest({a}, {a} + 7000)"
_END = f"""CASE WHEN size - {{a}} <= 8000 THEN size ELSE coalesce(
  list_max(list_filter(blanks, lambda o: o > {_BEGIN} AND o + 2 <= {{a}} + 8000)) + 2,
  greatest(list_max(list_filter(stops, lambda o: o - 2 > {_BEGIN} AND o <= {{a}} + 8000)) - 1, list_max(list_filter(ends, lambda o: o - 1 > {_BEGIN} AND o <= {{a}} + 8000))),
  list_max(list_filter(places, lambda o: o <= {{a}} + 8000))) END"""


@query(_SPLIT.format(first=_END.format(a="0"), next=_END.format(a="a")) + """
SELECT p.doc_id, part::INTEGER AS part, (b - a)::INTEGER AS bytes, sha256(substr(text, list_position(places, a)::BIGINT, list_position(places, b)::BIGINT - list_position(places, a)::BIGINT)) AS digest FROM parts p JOIN d ON d.doc_id = p.doc_id
UNION ALL SELECT doc_id, 0, octet_length(encode(text))::INTEGER, sha256(text) FROM documents WHERE octet_length(encode(text)) <= 8000""")
def split_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.split_content("text")).alias("part", "content"))
    return parts.select("doc_id", "part", F.octet_length("content").alias("bytes"), F.sha2("content", 256).alias("digest"))


_SHELL = [("rm -rf ", "delete"), ("mv a.txt ", "move"), ("cp -r a ", "write"), ("touch ", "write"), ("mkdir -p ", "write"), ("cat x > ", "write"), ("cat x | tee -a ", "write"), ("sed -i s/a/b/ ", "edit"), ("echo ", None)]


@query(f"""SELECT page_id, CASE page_id % 9 {" ".join(f"WHEN {i} THEN '{kind}'" for i, (_, kind) in enumerate(_SHELL) if kind)} END AS kind,
       CASE page_id % 9 WHEN 8 THEN NULL WHEN 2 THEN 'a' ELSE regexp_extract(url, '^[^ ]+') END AS path FROM pages""")
def shell_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    command = F.concat(F.element_at(F.array(*(F.lit(head) for head, _ in _SHELL)), (F.col("page_id") % 9 + 1).cast("int")), F.col("url"))
    op = F.try_element_at(files.shell_operations(command), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", op["kind"].alias("kind"), op["path"].alias("path"))


@query("""SELECT page_id, 0 AS place, 'edit' AS kind, url AS path FROM pages
UNION ALL SELECT page_id, 1, 'move', page_id::VARCHAR || '.new' FROM pages
UNION ALL SELECT page_id, 2, 'write', 'new/' || page_id::VARCHAR FROM pages
UNION ALL SELECT page_id, 3, 'delete', 'old/' || page_id::VARCHAR FROM pages""")
def patch_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("page_id").cast("string")
    lines = ["*** Begin Patch\n*** Update File: ", F.col("url"), "\n context \n+line\n*** Move to: ", number, ".new\n*** Add File: new/", number, "\n+text\n*** Delete File: old/", number, "\n*** End Patch"]
    patch = F.concat(*(F.lit(x) if isinstance(x, str) else x for x in lines))
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(files.patch_operations(patch)).alias("place", "op")).select("page_id", "place", "op.kind", "op.path")


@query("""SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'claudeapp' WHEN 1 THEN 'chatgpt' WHEN 2 THEN 'antigravity' WHEN 4 THEN 'gemini' WHEN 5 THEN 'codex' WHEN 6 THEN 'codex' WHEN 7 THEN 'claude' END AS kind FROM pages""")
def route_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    tails = ["claude-app/conversations.json", "conversations.json", "brain/x/transcript_full.jsonl", ".gemini/antigravity/notes.jsonl", ".gemini/tmp/p/chats/session-1.json", ".codex/sessions/a.jsonl", "logs/rollout-7.jsonl", "projects/-a-b/c.jsonl", "notes.txt"]
    path = F.concat(F.lit("/data/"), F.element_at(F.array(*map(F.lit, tails)), (F.col("page_id") % 9 + 1).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", files.source_kind(path).alias("kind"))


@query(f"""WITH e AS (SELECT user_id, ts, event_type FROM events)
SELECT user_id, CASE WHEN count(*) FILTER (ts < TIMESTAMP '{CUTOFF}') > 0 OR count(*) FILTER (event_type <> 'view' AND ts IS NULL) > 0 THEN 'refuse'
  WHEN count(*) FILTER (event_type = 'error') > 0 OR min(ts) IS NULL THEN 'wait' ELSE 'accept' END AS status FROM e GROUP BY user_id""")
def forward_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    judged = logs.eligibility(rows, "user_id", "ts", F.lit(CUTOFF).cast("timestamp"), F.col("event_type") != "view", F.col("event_type") == "error")
    return judged.select("user_id", "status")


_TARGET = "SELECT doc_id::VARCHAR AS Id, source AS MachineId, n_chars AS SourceLine FROM documents"
_SOURCE = "SELECT page_id::VARCHAR AS Id, 'pages' AS MachineId, octet_length(encode(html)) AS SourceLine FROM pages"


def _target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("Id"), F.col("source").alias("MachineId"), F.col("n_chars").alias("SourceLine"))


@query(f"WITH t AS ({_TARGET}), s AS ({_SOURCE}) SELECT * FROM t WHERE Id NOT IN (SELECT Id FROM s) UNION ALL SELECT * FROM s")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .table import merged

    source = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("Id"), F.lit("pages").alias("MachineId"), F.octet_length("html").cast("long").alias("SourceLine"))
    return merged(_target(spark, sf_dir), source)


@query(f"WITH t AS ({_TARGET}) SELECT * FROM t WHERE MachineId IS DISTINCT FROM 'src4'")
def delete_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .table import without_machine

    return without_machine(_target(spark, sf_dir), "src4")


@query("""SELECT left(sha256(doc_id::VARCHAR), 2) AS shard, count(*) AS processed FROM documents LEFT JOIN embeddings ON doc_id = vec_id
WHERE embedding IS NULL GROUP BY ALL""")
def backfill_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .table import HashEmbedder, backfilled, shard_report

    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    rows = docs.join(vectors, docs.doc_id == vectors.vec_id, "left").select(F.sha2(F.col("doc_id").cast("string"), 256).alias("Id"), F.col("text").alias("Content"), F.col("embedding").alias("Vector"))
    return shard_report(backfilled(rows, HashEmbedder(64), 64)).select("shard", "processed")


# readers: each source's log is written from ``conversations`` and read back -------------------------


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` with a time a second a turn after 2024, and columns for log lines."""
    stamp = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("conv_id") * 1000 + F.col("turn"))
    return table(spark, sf_dir, "conversations").withColumn("timestamp", F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def _log_files(rows: DataFrame, path: Column, line: Column, frame: Callable[[Column], Column] | None = None) -> DataFrame:
    """``path, content`` of a file a conversation; ``frame`` makes a document of its lines in order."""
    each = rows.select(path.alias("path"), "conv_id", "turn", line.alias("line"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"])
    body = F.array_join(ordered, "\n") if frame is None else frame(F.array_join(ordered, ","))
    return each.groupBy("path").agg(body.cast("binary").alias("content"))


def _read_back(chunks: DataFrame) -> DataFrame:
    return chunks.select("SourceFile", "SourceLine", "ChunkType", "SessionId", "ProjectPath", "ProjectName", F.unix_seconds("Timestamp").alias("seconds"), F.sha2("Content", 256).alias("digest"))


_TALK = """WITH r AS (SELECT conv_id, turn, role, text, 1704067200 + conv_id * 1000 + turn AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS line FROM conversations),
p AS (SELECT *, lag(role) OVER w AS before, lag(text) OVER w AS asked, lag(line) OVER w AS asked_line, lag(s) OVER w AS asked_s FROM r WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""
_DIGEST = "sha256({}) AS digest"


@query(f"""{_TALK}
SELECT '/home/me/projects/-w-demo/c' || conv_id || '.jsonl' AS SourceFile, asked_line AS SourceLine, 'turn' AS ChunkType, 's' || conv_id AS SessionId, '/w/demo' AS ProjectPath, 'demo' AS ProjectName, s AS seconds,
  {_DIGEST.format("'In project demo, user asked:' || chr(10) || asked || chr(10) || chr(10) || 'Assistant responded:' || chr(10) || text")} FROM p WHERE role = 'assistant' AND before = 'user'""")
def read_claude(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.when(F.col("role") == "assistant", F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content")))).otherwise(F.to_json(F.struct(F.col("text").alias("content"))))
    head = F.to_json(F.struct(F.col("role").alias("type"), F.concat(F.lit("s"), "conv_id").alias("sessionId"), "timestamp"))
    line = F.concat(F.expr("left(head, length(head) - 1)"), F.lit(',"message":'), F.col("message"), F.lit("}"))
    rows = _rows(spark, sf_dir).withColumn("message", message).withColumn("head", head)
    return _read_back(claude.chunks(_log_files(rows, F.concat(F.lit("/home/me/projects/-w-demo/c"), "conv_id", F.lit(".jsonl")), line))[0])


@query(f"""WITH r AS (SELECT conv_id, turn, role, text, 1704067200 + conv_id * 1000 + turn AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS line,
  sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations),
t AS (SELECT conv_id, g, min(line) AS line, min(s) AS s, min_by(text, line) AS asked, coalesce(string_agg(text, chr(10) ORDER BY line) FILTER (role <> 'user'), '') AS answer FROM r WHERE g > 0 GROUP BY ALL),
c AS (SELECT conv_id, line, s, 'In project demo, user asked:' || chr(10) || asked || chr(10) || chr(10) || 'Assistant responded:' || chr(10) || answer AS content FROM t
  UNION ALL SELECT conv_id, line, s, 'In project demo, assistant responded:' || chr(10) || text FROM r WHERE g = 0)
SELECT '/logs/rollout-' || conv_id || '.jsonl' AS SourceFile, line AS SourceLine, 'turn' AS ChunkType, 'unknown' AS SessionId, '/w/demo' AS ProjectPath, 'demo' AS ProjectName, s AS seconds, {_DIGEST.format("content")} FROM c""")
def read_codex(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("role") == "user", "input_text").otherwise("output_text")
    payload = F.struct(F.lit("message").alias("type"), "role", F.array(F.struct(kind.alias("type"), "text")).alias("content"))
    line = F.to_json(F.struct(F.lit("response_item").alias("type"), "timestamp", payload.alias("payload")))
    # where a session has no line of its own, its folder is told by one that shares the first line
    rows = _rows(spark, sf_dir)
    context = rows.groupBy("conv_id").agg(F.min("turn").alias("turn"), F.min("timestamp").alias("timestamp")).withColumn("turn", F.col("turn") - 1)
    opening = F.to_json(F.struct(F.lit("turn_context").alias("type"), "timestamp", F.struct(F.lit("/w/demo").alias("cwd")).alias("payload")))
    path = F.concat(F.lit("/logs/rollout-"), "conv_id", F.lit(".jsonl"))
    both = rows.select("conv_id", "turn", line.alias("line")).unionByName(context.select("conv_id", "turn", opening.alias("line")))
    found = _read_back(codex.chunks(_log_files(both, path, F.col("line")))[0])
    return found.withColumn("SourceLine", F.col("SourceLine") - 1)


@query(f"""WITH r AS (SELECT conv_id, turn, role, text, 1704067200 + conv_id * 1000 + turn AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations),
p AS (SELECT *, lag(role) OVER w AS before, lag(text) OVER w AS asked, lag(place) OVER w AS asked_place, lag(s) OVER w AS asked_s FROM r WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT '/x/' || conv_id || '/conversations.json' AS SourceFile, 100000 + place + 1 AS SourceLine, 'turn' AS ChunkType, 'c' || conv_id AS SessionId, s AS seconds,
  {_DIGEST.format("'In ChatGPT conversation T' || conv_id || ', user asked:' || chr(10) || asked || chr(10) || chr(10) || 'ChatGPT responded:' || chr(10) || text")} FROM p WHERE role = 'assistant' AND before = 'user'""")
def read_chatgpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.to_json(F.struct(F.col("role"), F.col("text").alias("content"), F.col("timestamp").alias("created_at")))
    rows = _rows(spark, sf_dir)
    path = F.concat(F.lit("/x/"), "conv_id", F.lit("/conversations.json"))
    number = F.regexp_extract("path", "[0-9]+", 0)
    files_ = _log_files(rows, path, line, lambda x: x).select("path", F.concat(F.lit('[{"id":"c'), number, F.lit('","title":"T'), number, F.lit('","messages":['), F.col("content").cast("string"), F.lit("]}]")).cast("binary").alias("content"))
    return _read_back(exports.chatgpt_chunks(files_)[0]).drop("ProjectPath", "ProjectName")


@query(f"""WITH r AS (SELECT conv_id, turn, role, text, 1704067200 + conv_id * 1000 + turn AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations),
p AS (SELECT *, lag(role) OVER w AS before, lag(text) OVER w AS asked FROM r WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT '/claude-app/' || conv_id || '/conversations.json' AS SourceFile, 100000 + place + 1 AS SourceLine, 'turn' AS ChunkType, 'c' || conv_id AS SessionId, s AS seconds,
  {_DIGEST.format("'In Claude app conversation T' || conv_id || ', user asked:' || chr(10) || asked || chr(10) || chr(10) || 'Claude responded:' || chr(10) || text")} FROM p WHERE role = 'assistant' AND before = 'user'""")
def read_claude_app(spark: SparkSession, sf_dir: str) -> DataFrame:
    sender = F.when(F.col("role") == "user", "human").otherwise(F.col("role"))
    line = F.to_json(F.struct(sender.alias("sender"), "text", F.col("timestamp").alias("created_at")))
    path = F.concat(F.lit("/claude-app/"), "conv_id", F.lit("/conversations.json"))
    number = F.regexp_extract("path", "[0-9]+", 0)
    files_ = _log_files(_rows(spark, sf_dir), path, line, lambda x: x).select("path", F.concat(F.lit('[{"uuid":"c'), number, F.lit('","name":"T'), number, F.lit('","chat_messages":['), F.col("content").cast("string"), F.lit("]}]")).cast("binary").alias("content"))
    return _read_back(exports.claudeapp_chunks(files_)[0]).drop("ProjectPath", "ProjectName")


#: Lines of ``conversations`` in SQL: the time a second a turn, and the running number of questions.
_LINES = """WITH r AS (SELECT conv_id, turn, role, text, 1704067200 + conv_id * 1000 + turn AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS line,
  sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations)"""
#: Text of at most 200 bytes, not cut within a character.
_PROMPT = "CASE WHEN octet_length(encode(asked)) <= 200 THEN asked ELSE left(asked, list_max(list_filter(range(201), lambda i: octet_length(encode(left(asked, i))) <= 200))) || '...' END"


@query(f"""{_LINES},
m AS (SELECT *, text || CASE WHEN role = 'assistant' AND turn % 3 = 0 THEN chr(10) || '[Used Write on /w/f' || turn || '.py]' ELSE '' END AS said, line + 1 AS place FROM r),
p AS (SELECT *, lag(role) OVER w AS before, lag(text) OVER w AS asked, lag(place) OVER w AS asked_place FROM m WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
e AS (SELECT conv_id, min(s) AS first_s, max(s) AS last_s, count(*) AS n FROM r GROUP BY conv_id),
c AS (
  SELECT conv_id, asked_place AS line, 'turn' AS kind, s, 'In project demo, user asked:' || chr(10) || asked || chr(10) || chr(10) || 'Assistant responded:' || chr(10) || said AS content FROM p WHERE role = 'assistant' AND before = 'user'
  UNION ALL SELECT conv_id, place, 'file_change', s, 'In project demo, file /w/f' || turn || '.py was write. Created/overwrote file. This was in response to: ' || CASE WHEN before = 'user' THEN {_PROMPT} ELSE '[unpaired assistant message]' END FROM p WHERE role = 'assistant' AND turn % 3 = 0
  UNION ALL SELECT conv_id, 1, 'turn', first_s, 'In project demo, linked pull request in r #' || conv_id || ': u' || conv_id FROM e
  UNION ALL SELECT conv_id, n + 2, 'summary', last_s, 'Session summary for demo:' || chr(10) || CASE WHEN conv_id % 2 = 0 THEN 'All of it' ELSE 'Name ' || conv_id END FROM e)
SELECT '/home/me/projects/-w-demo/c' || conv_id || '.jsonl' AS SourceFile, line AS SourceLine, kind AS ChunkType, 's' || conv_id AS SessionId, '/w/demo' AS ProjectPath, 'demo' AS ProjectName, s AS seconds, {_DIGEST.format("content")} FROM c""")
def read_claude_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts with summaries, titles, links and writes; lines without a time carry one."""
    rows, turn, conv = _rows(spark, sf_dir), F.col("turn").cast("string"), F.col("conv_id").cast("string")
    written = F.concat(F.lit(',{"type":"tool_use","name":"Write","id":"t'), turn, F.lit('","input":{"file_path":"/w/f'), turn, F.lit('.py"}}'))
    answer = F.concat(F.lit('{"content":[{"type":"text","text":'), _json(F.col("text")), F.lit("}"), F.when(F.col("turn") % 3 == 0, written).otherwise(""), F.lit("]}"))
    message = F.when(F.col("role") == "assistant", answer).otherwise(F.concat(F.lit('{"content":'), _json(F.col("text")), F.lit("}")))
    said = F.concat(F.lit('{"type":'), _json(F.col("role")), F.lit(',"sessionId":"s'), conv, F.lit('","timestamp":"'), F.col("timestamp"), F.lit('","message":'), message, F.lit("}"))
    link = F.concat(F.lit('{"type":"pr-link","prUrl":"u'), conv, F.lit('","prNumber":'), conv, F.lit(',"prRepository":"r"}'))
    closing = F.when(F.col("conv_id") % 2 == 0, F.lit('{"type":"summary","summary":"All of it"}')).otherwise(F.concat(F.lit('{"type":"custom-title","customTitle":"Name '), conv, F.lit('"}')))
    ends = F.when(F.col("last"), F.array(said, closing)).otherwise(F.array(said))
    rows = _with_ends(rows).select("conv_id", "turn", F.posexplode(F.when(F.col("first"), F.concat(F.array(link), ends)).otherwise(ends)).alias("k", "line"))
    rows = rows.withColumn("turn", F.col("turn") * 4 + F.col("k"))
    return _read_back(claude.chunks(_log_files(rows, F.concat(F.lit("/home/me/projects/-w-demo/c"), "conv_id", F.lit(".jsonl")), F.col("line")))[0])


def _json(text: Column) -> Column:
    """A text as a JSON string."""
    whole = F.to_json(F.array(text))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def _with_ends(rows: DataFrame) -> DataFrame:
    """``rows`` with ``first`` and ``last``: whether a row is the first or last of its conversation."""
    ends = rows.groupBy("conv_id").agg(F.min("turn").alias("low"), F.max("turn").alias("high"))
    return rows.join(ends, "conv_id").withColumn("first", F.col("turn") == F.col("low")).withColumn("last", F.col("turn") == F.col("high"))


_CALL = """'[Tool call] shell {{"command":"touch f' || turn || '.txt"}}'"""


@query(f"""{_LINES},
x AS (SELECT *, 0 AS k, text AS said FROM r UNION ALL SELECT *, 1, {_CALL.format()} FROM r WHERE role <> 'user' AND turn % 3 = 0),
m AS (SELECT * EXCLUDE line, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) + 1 AS line FROM x),
t AS (SELECT conv_id, g, min(line) AS line, min(s) AS s, min_by(said, line) AS asked, coalesce(string_agg(said, chr(10) ORDER BY line) FILTER (role <> 'user'), '') AS answer FROM m WHERE g > 0 GROUP BY ALL),
c AS (SELECT conv_id, line, 'turn' AS kind, s, 'In project demo, user asked:' || chr(10) || asked || chr(10) || chr(10) || 'Assistant responded:' || chr(10) || answer AS content FROM t
  UNION ALL SELECT conv_id, line, 'turn', s, 'In project demo, assistant responded:' || chr(10) || said FROM m WHERE g = 0
  UNION ALL SELECT m.conv_id, coalesce(t.line, m.line), 'file_change', coalesce(t.s, m.s), 'In project demo, file f' || turn || '.txt was write.' || chr(10) || 'Summary: Touched file' FROM m LEFT JOIN t ON t.conv_id = m.conv_id AND t.g = m.g WHERE k = 1)
SELECT '/logs/rollout-' || conv_id || '.jsonl' AS SourceFile, line AS SourceLine, kind AS ChunkType, 'unknown' AS SessionId, '/w/demo' AS ProjectPath, 'demo' AS ProjectName, s AS seconds, {_DIGEST.format("content")} FROM c""")
def read_codex_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollout logs with shell calls, whose files belong to the question before them."""
    rows, turn = _rows(spark, sf_dir), F.col("turn").cast("string")
    kind = F.when(F.col("role") == "user", "input_text").otherwise("output_text")
    payload = F.struct(F.lit("message").alias("type"), "role", F.array(F.struct(kind.alias("type"), "text")).alias("content"))
    said = F.to_json(F.struct(F.lit("response_item").alias("type"), "timestamp", payload.alias("payload")))
    call = F.concat(F.lit('{"type":"response_item","timestamp":"'), F.col("timestamp"), F.lit('","payload":{"type":"function_call","name":"shell","arguments":{"command":"touch f'), turn, F.lit('.txt"}}}'))
    context = F.concat(F.lit('{"type":"turn_context","timestamp":"'), F.col("timestamp"), F.lit('","payload":{"cwd":"/w/demo"}}'))
    lines = F.array_compact(F.array(F.when(F.col("first"), context), said, F.when((F.col("role") != "user") & (F.col("turn") % 3 == 0), call)))
    rows = _with_ends(rows).select("conv_id", "turn", F.posexplode(lines).alias("k", "line")).withColumn("turn", F.col("turn") * 4 + F.col("k"))
    return _read_back(codex.chunks(_log_files(rows, F.concat(F.lit("/logs/rollout-"), "conv_id", F.lit(".jsonl")), F.col("line")))[0])


_GEMINI_CALL = """chr(10) || chr(10) || 'Tool calls:' || chr(10) || '{{"args":{{"command":"touch f' || turn || '.txt"}},"id":"1","name":"shell","resultDisplay":""}}'"""


@query(f"""{_LINES},
m AS (SELECT *, text || CASE WHEN role = 'assistant' AND turn % 3 = 0 THEN {_GEMINI_CALL.format()} ELSE '' END AS said FROM r),
t AS (SELECT conv_id, g, min(line) AS line, min(s) AS s, min_by(said, line) AS asked, coalesce(string_agg(said, chr(10) ORDER BY line) FILTER (role = 'assistant'), '') AS answer FROM m WHERE g > 0 GROUP BY ALL),
c AS (SELECT conv_id, line, 'turn' AS kind, s, 'In project demo, user asked:' || chr(10) || asked || chr(10) || chr(10) || 'Assistant responded:' || chr(10) || answer AS content FROM t
  UNION ALL SELECT conv_id, line, 'turn', s, 'In project demo, assistant responded:' || chr(10) || said FROM m WHERE role = 'system' OR (role = 'assistant' AND g = 0)
  UNION ALL SELECT m.conv_id, coalesce(t.line, m.line), 'file_change', coalesce(t.s, m.s), 'In project demo, file f' || turn || '.txt was write.' || chr(10) || 'Summary: Touched file' FROM m LEFT JOIN t ON t.conv_id = m.conv_id AND t.g = m.g WHERE role = 'assistant' AND turn % 3 = 0)
SELECT '/home/me/.gemini/tmp/demo/chats/session-' || conv_id || '.json' AS SourceFile, line AS SourceLine, kind AS ChunkType, 's' || conv_id AS SessionId, '/gemini/demo' AS ProjectPath, 'demo' AS ProjectName, s AS seconds, {_DIGEST.format("content")} FROM c""")
def read_gemini(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session documents with replies, notices and shell calls."""
    turn = F.col("turn").cast("string")
    kind = F.when(F.col("role") == "assistant", "gemini").when(F.col("role") == "system", "info").otherwise(F.col("role"))
    call = F.concat(F.lit(',"toolCalls":[{"name":"shell","args":{"command":"touch f'), turn, F.lit('.txt"}}]'))
    item = F.concat(F.lit('{"type":"'), kind, F.lit('","timestamp":"'), F.col("timestamp"), F.lit('","content":'), _json(F.col("text")), F.when((F.col("role") == "assistant") & (F.col("turn") % 3 == 0), call).otherwise(""), F.lit("}"))
    path = F.concat(F.lit("/home/me/.gemini/tmp/demo/chats/session-"), "conv_id", F.lit(".json"))
    number = F.regexp_extract("path", "[0-9]+", 0)
    docs = _log_files(_rows(spark, sf_dir), path, item, lambda x: x).select("path", F.concat(F.lit('{"sessionId":"s'), number, F.lit('","messages":['), F.col("content").cast("string"), F.lit("]}")).cast("binary").alias("content"))
    return _read_back(gemini.chunks(docs)[0])


_STEP = """CASE WHEN conv_id % 2 = 0 THEN 'Title: T' || conv_id || chr(10) || chr(10) ELSE '' END || 'Source: ' || CASE role WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'agent' ELSE 'system' END || chr(10) || chr(10) || 'Type: ' || CASE role WHEN 'user' THEN 'USER_INPUT' WHEN 'assistant' THEN 'PLANNER_RESPONSE' ELSE 'SYSTEM_MESSAGE' END
  || chr(10) || chr(10) || 'Status: unknown' || chr(10) || chr(10) || 'Content:' || chr(10) || text || CASE WHEN turn % 3 = 0 THEN chr(10) || chr(10) || 'Tool calls:' || chr(10) || '[{"ID":"1","Name":"edit_file","Args":{"file_path":"/w/f' || turn || '.py"}}]' ELSE '' END"""


@query(f"""{_LINES},
c AS (SELECT conv_id, line, 'turn' AS kind, s, {_STEP} AS content FROM r
  UNION ALL SELECT conv_id, line, 'file_change', s, 'In Antigravity session s' || conv_id || ', file /w/f' || turn || '.py was edit.' || chr(10) || 'Summary: edit_file tool call' FROM r WHERE turn % 3 = 0)
SELECT '/antigravity/brain/s' || conv_id || '/transcript_full.jsonl' AS SourceFile, line AS SourceLine, kind AS ChunkType, 's' || conv_id AS SessionId,
  CASE WHEN conv_id % 2 = 0 THEN '/w/p' || conv_id ELSE '/antigravity/s' || conv_id END AS ProjectPath, CASE WHEN conv_id % 2 = 0 THEN 'p' || conv_id ELSE 'Antigravity Session' END AS ProjectName, s AS seconds, {_DIGEST.format("content")} FROM c""")
def read_antigravity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step transcripts with tool calls; half of the sessions have a title and a workspace in the side table."""
    rows, turn = _rows(spark, sf_dir), F.col("turn").cast("string")
    kind = F.when(F.col("role") == "user", "USER_INPUT").when(F.col("role") == "assistant", "PLANNER_RESPONSE").otherwise("SYSTEM_MESSAGE")
    call = F.concat(F.lit(',"tool_calls":[{"name":"edit_file","args":{"file_path":"/w/f'), turn, F.lit('.py"}}]'))
    line = F.concat(F.lit('{"type":"'), kind, F.lit('","created_at":"'), F.col("timestamp"), F.lit('","step_index":'), turn, F.lit(',"content":'), _json(F.col("text")), F.when(F.col("turn") % 3 == 0, call).otherwise(""), F.lit("}"))
    number = F.col("conv_id").cast("string")
    sessions = rows.where("conv_id % 2 = 0").select(F.concat(F.lit("s"), number).alias("session"), F.concat(F.lit("T"), number).alias("title"), F.concat(F.lit("/w/p"), number).alias("workspace"), F.concat(F.lit("p"), number).alias("workspace_name")).distinct()
    path = F.concat(F.lit("/antigravity/brain/s"), "conv_id", F.lit("/transcript_full.jsonl"))
    return _read_back(antigravity.chunks(_log_files(rows, path, line), sessions=sessions)[0])


@query(f"""WITH r AS (SELECT conv_id, turn, role, text, 1704067200 + conv_id * 1000 + turn AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
p AS (SELECT *, lag(role) OVER w AS before, lag(text) OVER w AS asked FROM r WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT '/x/' || conv_id || '/conversations.json' AS SourceFile, 100000 + n AS SourceLine, 'turn' AS ChunkType, 'c' || conv_id AS SessionId, s AS seconds,
  {_DIGEST.format("'In ChatGPT conversation Untitled, user asked:' || chr(10) || asked || chr(10) || '!' || chr(10) || chr(10) || 'ChatGPT responded:' || chr(10) || text || chr(10) || '!'")} FROM p WHERE role = 'assistant' AND before = 'user'""")
def read_chatgpt_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports whose conversations are graphs of nodes in any order, with nested contents."""
    node = F.concat(F.lit('"n'), F.lpad((100 - F.col("turn")).cast("string"), 4, "0"), F.lit('":{"message":{"author":{"role":'), _json(F.col("role")), F.lit('},"create_time":'), F.unix_timestamp(F.to_timestamp("timestamp")).cast("string"), F.lit(',"content":{"parts":['), _json(F.col("text")), F.lit(',{"text":"!"}]}}}'))
    path = F.concat(F.lit("/x/"), "conv_id", F.lit("/conversations.json"))
    number = F.regexp_extract("path", "[0-9]+", 0)
    docs = _log_files(_rows(spark, sf_dir), path, node, lambda x: x).select("path", F.concat(F.lit('{"conversations":[{"conversation_id":"c'), number, F.lit('","mapping":{'), F.col("content").cast("string"), F.lit("}}]}")).cast("binary").alias("content"))
    return _read_back(exports.chatgpt_chunks(docs)[0]).drop("ProjectPath", "ProjectName")


@query("""WITH r AS (SELECT conv_id % 16 AS file, conv_id, turn, md5(conv_id || ':' || turn) AS text FROM conversations),
l AS (SELECT file, conv_id, turn, 0 AS k, text FROM r UNION ALL SELECT file, conv_id, turn, 1, '' FROM r WHERE turn % 3 = 0 UNION ALL SELECT file, conv_id, turn, 2, 'é' || chr(13) FROM r WHERE turn % 5 = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY conv_id, turn, k) AS line FROM l)
SELECT file::INTEGER AS file, line, text FROM n""")
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files of many lines, written by Spark and read in splits with their physical line numbers."""
    rows = table(spark, sf_dir, "conversations").withColumn("file", (F.col("conv_id") % 16).cast("int"))
    text_ = F.md5(F.concat("conv_id", F.lit(":"), "turn").cast("binary"))
    more = F.when(F.col("turn") % 3 == 0, F.lit("\n")).otherwise(""), F.when(F.col("turn") % 5 == 1, F.lit("\né\r")).otherwise("")
    folder = scratch_folder(spark, "log-lines")
    lines = rows.repartition("file").sortWithinPartitions("file", "conv_id", "turn").select("file", F.concat(text_, *more).alias("value"))
    lines.write.partitionBy("file").option("lineSep", "\n").text(folder)
    found = common.read_lines(spark, folder, "*.txt")
    return found.select(F.regexp_extract("path", "file=([0-9]+)", 1).cast("int").alias("file"), "line", "text")


# the table, its bounds, the wire, and ingest requests over whole tables ---------------------------

_FIRST = """SELECT 'd' || doc_id AS Id, text, source FROM documents JOIN embeddings ON doc_id = vec_id WHERE octet_length(encode(text)) > 0 AND len(embedding) = {size}
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: abs(x) >= 1e-10)) > 0""".format(size="(SELECT max(len(embedding)) FROM embeddings)")


def _chunks(rows: DataFrame, vector_: Column | None = None) -> DataFrame:
    """Rows ``Id, text, source`` as chunks."""
    fixed = {"ChunkType": "turn", "SessionId": "s", "ProjectPath": "/p", "ProjectName": "p", "SourceFile": "f"}
    more = [F.lit(v).alias(k) for k, v in fixed.items()]
    return rows.select("Id", F.col("text").alias("Content"), *more, F.timestamp_seconds(F.lit(1_704_067_200)).alias("Timestamp"), F.lit(1).alias("SourceLine"), F.col("source").alias("MachineId"), (F.lit(None) if vector_ is None else vector_).cast("array<float>").alias("Vector"))


@query(f"""WITH a AS ({_FIRST}),
b AS (SELECT 'd' || doc_id AS Id, CASE WHEN doc_id % 2 = 0 THEN text ELSE text || '!' END AS text, source FROM documents WHERE doc_id % 3 = 0 AND octet_length(encode(text)) > 0),
u AS (SELECT Id, text, source, false AS again FROM a WHERE Id NOT IN (SELECT Id FROM b) UNION ALL SELECT Id, text, source, true FROM b)
SELECT u.Id, sha256(u.text) AS digest, a.Id IS NOT NULL AND a.text = u.text AS embedded FROM u LEFT JOIN a ON a.Id = u.Id WHERE u.source IS DISTINCT FROM 'src4'""")
def table_upsert_deferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table is filled, a third of it written again without vectors, and a machine deleted; vectors of unchanged texts stay."""
    from .schema import vector_error
    from .table import ChunkTable

    docs, vectors = table(spark, sf_dir, "documents").where(F.octet_length("text") > 0), table(spark, sf_dir, "embeddings")
    size = vectors.agg(F.max(F.size("embedding"))).first()[0]
    store = ChunkTable(spark, scratch_folder(spark, "chunks"), size, buckets=8)
    store.initialize()
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("Id")
    first = docs.join(vectors.where(F.col("embedding").isNotNull() & vector_error("embedding", size).isNull()), F.col("doc_id") == F.col("vec_id"))
    store.upsert(_chunks(first.select(name, "text", "source", "embedding"), F.col("embedding")))
    text_ = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit("!")))
    store.upsert(_chunks(docs.where("doc_id % 3 = 0").select(name, text_.alias("text"), "source")))
    store.delete_machine("src4")
    return store.read().select("Id", F.sha2("Content", 256).alias("digest"), F.col("Vector").isNotNull().alias("embedded"))


_CHECKS = """[CASE WHEN doc_id % 70 = 0 THEN 'Id_missing' END, CASE WHEN doc_id % 70 > 64 THEN 'Id_too_long' END,
  CASE WHEN coalesce(octet_length(encode(text)), 0) = 0 THEN 'Content_missing' END, CASE WHEN doc_id % 40 > 32 THEN 'ChunkType_too_long' END, CASE WHEN doc_id % 40 = 0 THEN 'ChunkType_missing' END,
  CASE WHEN doc_id % 90 = 89 THEN 'Operation_too_long' END, CASE WHEN doc_id % 11 = 0 THEN 'Timestamp_missing' END, CASE WHEN doc_id % 7 = 0 THEN 'SourceLine_negative' END,
  CASE WHEN doc_id % 17 = 3 THEN 'ChildChunkIds_bad' END,
  CASE WHEN doc_id % 5 = 1 THEN 'vector_dimension' WHEN doc_id % 5 = 2 THEN 'vector_not_finite' WHEN doc_id % 5 = 3 THEN 'vector_zero' END]"""


@query(f"SELECT doc_id, array_to_string(list_sort(list_filter({_CHECKS}, lambda x: x IS NOT NULL)), ',') AS errors FROM documents")
def chunk_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All bounds that rows break, which are made to break them by their id."""
    from .schema import chunk_errors

    n, bad = F.col("doc_id"), [F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(float("nan"))), F.array(F.lit(0.0), F.lit(1e-12))]
    vector_ = F.when(n % 5 == 1, bad[0]).when(n % 5 == 2, bad[1]).when(n % 5 == 3, bad[2]).when(n % 5 == 4, F.array(F.lit(0.0), F.lit(1.0)))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.repeat(F.lit("x"), (n % 70).cast("int")).alias("Id"),
        F.col("text").alias("Content"),
        F.repeat(F.lit("x"), (n % 40).cast("int")).alias("ChunkType"),
        *(F.lit("given").alias(c) for c in ("SessionId", "ProjectPath", "ProjectName", "SourceFile")),
        *(F.lit(None).cast("string").alias(c) for c in ("UserUuid", "AssistantUuid", "FilePath", "Model", "ParentChunkId", "MachineId")),
        F.when(n % 90 == 89, F.repeat(F.lit("é"), 17)).alias("Operation"),
        F.when(n % 11 != 0, F.timestamp_seconds(n)).alias("Timestamp"),
        (n % 7 - 1).alias("SourceLine"),
        F.when(n % 17 == 3, F.array(F.lit("ok"), F.lit(""))).when(n % 17 == 4, F.array(F.lit("ok"))).alias("ChildChunkIds"),
        vector_.cast("array<float>").alias("Vector"),
    )
    return rows.select("doc_id", F.array_join(F.array_sort(chunk_errors(2)), ",").alias("errors"))


@query("""SELECT 'd' || doc_id AS id, sha256(text) AS content, 'turn' AS chunk_type, 's' AS session_id, coalesce(lang, '') AS project_path, 'p' AS project_name,
  strftime(TIMESTAMP '2024-01-01' + to_microseconds(doc_id * 1001500), '%Y-%m-%dT%H:%M:%S') || CASE WHEN doc_id * 1001500 % 1000000 = 0 THEN '' ELSE '.' || rtrim(printf('%06d', doc_id * 1001500 % 1000000), '0') END || 'Z' AS timestamp,
  CASE WHEN doc_id % 3 = 0 THEN 'a.py' ELSE '' END AS file_path, '' AS operation, coalesce(source, '') AS source_file, doc_id / 4 AS distance, 'exact' AS search_type FROM documents""")
def wire_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results under their wire names: null text is empty, times are RFC 3339 without trailing zeros."""
    from .plans.engine import wire

    n = F.col("doc_id")
    found = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), n.cast("string")).alias("Id"), F.sha2("text", 256).alias("Content"), F.lit("turn").alias("ChunkType"), F.lit("s").alias("SessionId"), F.col("lang").alias("ProjectPath"), F.lit("p").alias("ProjectName"), F.timestamp_micros(1_704_067_200_000_000 + n * 1_001_500).alias("Timestamp"), F.when(n % 3 == 0, "a.py").alias("FilePath"), F.lit(None).cast("string").alias("Operation"), F.col("source").alias("SourceFile"), (n / 4).alias("Distance"), F.lit("exact").alias("SearchType"))
    return wire(found)


@query("""WITH r AS (SELECT conv_id, turn, role, text, strftime(to_timestamp(1704067200 + conv_id * 1000 + turn) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM conversations),
c AS (SELECT conv_id, turn, '{"id":"' || sha256(conv_id || ':' || turn) || '","content":' || to_json(text) || ',"chunk_type":"turn","session_id":"s' || conv_id || '","project_path":"/w/demo","project_name":"demo","timestamp":"' || stamp || '"'
    || CASE WHEN role = 'user' THEN ',"user_uuid":"u' || turn || '"' ELSE ',"model":"m"' END || ',"source_file":"c' || conv_id || '.jsonl","source_line":' || turn + 1 || '}' AS line FROM r),
p AS (SELECT conv_id, count(*) AS chunks, '[' || string_agg(line, ',' ORDER BY turn) || ']' AS payload, max(turn) + 1 AS n FROM c GROUP BY conv_id),
b AS (SELECT conv_id, chunks, payload, '{"schema_version":1,"machine_id":"mac","source":{"format":"codex_jsonl","root_volume":"0000000000000001","root_object":"' || printf('%016x', conv_id) || '","relative_path":"c' || conv_id || '.jsonl"},"cursor":{"kind":"physical_lines","start_exclusive":0,"end_inclusive":' || n || ',"prefix_sha256":"' || sha256('c' || conv_id) || '"},"generation":"g","chunks":' || payload || '}' AS body FROM p)
SELECT conv_id, chunks, octet_length(encode(body)) AS bytes, sha256(body) AS request_sha256, sha256(payload) AS payload_sha256, sha256(encode('talewarp/record/v1') || '\x00'::BLOB || unhex(sha256(body))) AS record_id, NULL::VARCHAR AS error FROM b""")
def ingest_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each conversation as canonical JSON, with its digests and record id."""
    from .sources import ingest

    conv, turn, none = F.col("conv_id"), F.col("turn"), F.lit(None).cast("string")
    path = F.concat(F.lit("c"), conv.cast("string"), F.lit(".jsonl"))
    most = table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.max("turn") + 1).alias("n"))
    cursor = F.struct(F.lit("physical_lines").alias("kind"), F.lit(0).alias("start_exclusive"), F.col("n").alias("end_inclusive"), F.sha2(F.concat(F.lit("c"), conv.cast("string")), 256).alias("prefix_sha256"), none.alias("revision_sha256"), none.alias("previous_revision_sha256"))
    rows = table(spark, sf_dir, "conversations").join(most, "conv_id").select(
        "conv_id",
        turn.alias("ordinal"),
        F.sha2(F.concat_ws(":", conv, turn), 256).alias("Id"),
        F.col("text").alias("Content"),
        F.lit("turn").alias("ChunkType"),
        F.concat(F.lit("s"), conv.cast("string")).alias("SessionId"),
        F.lit("/w/demo").alias("ProjectPath"),
        F.lit("demo").alias("ProjectName"),
        F.timestamp_seconds(F.lit(1_704_067_200) + conv * 1000 + turn).alias("Timestamp"),
        F.when(F.col("role") == "user", F.concat(F.lit("u"), turn.cast("string"))).alias("UserUuid"),
        F.when(F.col("role") != "user", "m").alias("Model"),
        *(F.lit("").alias(c) for c in ("AssistantUuid", "FilePath", "Operation", "ParentChunkId", "client_name")),
        path.alias("SourceFile"),
        (turn + 1).alias("SourceLine"),
        F.lit(None).cast("array<string>").alias("ChildChunkIds"),
        F.lit("mac").alias("machine_id"),
        ingest.source_struct(F.lit("codex_jsonl"), F.lit(1), conv, path, none).alias("source"),
        cursor.alias("cursor"),
        F.lit("g").alias("generation"),
    )
    return ingest.encoded(rows, ["conv_id"]).select("conv_id", "chunks", F.octet_length("body").cast("long").alias("bytes"), "request_sha256", "payload_sha256", "record_id", "error")


@query(f"""WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN TIMESTAMP '1970-01-01 00:00:01' ELSE ts END AS ts FROM events),
v AS (SELECT *, CASE WHEN ts >= TIMESTAMP '{CUTOFF}' THEN ts END AS timely FROM e)
SELECT event_id, user_id, CASE WHEN ts IS NULL OR ts < TIMESTAMP '1970-01-01 00:00:02' THEN coalesce(last_value(timely IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING),
  first_value(timely IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), TIMESTAMP '{CUTOFF}') ELSE ts END AS repaired FROM v""")
def timestamp_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing times become the nearest one at or after the cutoff."""
    ts = F.when(F.col("event_id") % 3 == 1, F.timestamp_seconds(F.lit(1))).when(F.col("event_id") % 3 == 2, F.col("ts").cast("timestamp"))
    events = table(spark, sf_dir, "events").select("event_id", "user_id", ts.alias("ts"))
    fixed = logs.repaired_timestamp("ts", F.lit(CUTOFF).cast("timestamp"), ["user_id"], ["event_id"])
    return events.select("event_id", "user_id", fixed.cast("timestamp_ntz").alias("repaired"))


# the same searches as SQL table functions ------------------------------------------------------------

_HYBRID = ORACLE_SQL["hybrid_rrf_topk"].replace("SELECT f.id AS doc_id, lang, source, ", "SELECT f.id AS doc_id, ")


def _as_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    both = docs.join(vectors, F.col("doc_id") == F.col("vec_id"), "left")
    return both.select(F.format_string("%012d", "doc_id").alias("Id"), F.col("text").alias("Content"), F.col("embedding").alias("Vector"), F.col("lang").alias("ProjectPath"), F.lit("turn").alias("ChunkType"), F.col("source").alias("SessionId"), F.timestamp_seconds(F.col("n_chars")).alias("Timestamp"))


@query(_HYBRID)
def sql_hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql.register(_as_chunks(spark, sf_dir))
    near = F.array(*map(F.lit, _query_vector(spark, sf_dir)))
    top = spark.sql("SELECT * FROM hybrid_search(:near, :words, :most)", args={"near": near, "words": TEXT_QUERY, "most": TOP})
    return top.select(F.col("Id").cast("long").alias("doc_id"), F.round("Distance", 6).alias("distance"))


@query("""SELECT source, doc_id, n_chars FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents WHERE lang = 'en')
WHERE n = 1 ORDER BY n_chars DESC, doc_id LIMIT 7""")
def sql_latest_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql.register(_as_chunks(spark, sf_dir))
    found = spark.sql("SELECT * FROM latest_sessions(7, :project)", args={"project": "en"})
    return found.select(F.col("SessionId").alias("source"), F.col("Id").cast("long").alias("doc_id"), F.unix_seconds("Timestamp").alias("n_chars"))
