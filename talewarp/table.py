"""The chunk table on Parquet: versions, upsert, delete, backfill and the indexes.

Rows lie in ``buckets`` by a hash of their id. A write makes a new folder with the
buckets that it touches; the table's state names the folder of each bucket. States are
numbered files (``versions``), so a batch is visible as a whole or not at all, a job that
dies leaves the table as it was, and of two writers that start from one state the second
repeats its work on the first one's.

The search index and the vector index are written with each folder, from the same rows,
and read through the same state: an entry counts if the state names its folder for its
bucket. So both always answer for the table as it is, after any write or restart.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import logs, summaries, tree, vector
from .operators import text as fulltext
from .schema import CHUNK, DIMENSION, chunk_errors, normalized
from .versions import Conflict, Versions

MAX_BATCH = 500


class Embedder(Protocol):
    """Turns texts into vectors. ``task`` tells documents from queries."""

    dimension: int

    def embed(self, texts: list[str], task: str) -> list[list[float]]: ...


class HashEmbedder:
    """Hashed bag of words, normalised: deterministic and offline."""

    def __init__(self, dimension: int = DIMENSION):
        self.dimension = dimension

    def embed(self, texts: list[str], task: str = "RETRIEVAL_DOCUMENT") -> list[list[float]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        out = [0.0] * self.dimension
        for word in re.findall(r"\w+", text.lower()) or [""]:
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
            out[h % self.dimension] += 1.0 if h >> 63 else -1.0
        norm = math.sqrt(sum(x * x for x in out))
        return [x / norm for x in out] if norm else [1.0, *out[1:]]


class InvalidChunks(ValueError):
    """A batch with a row that breaks the table's bounds."""


def embedded(rows: DataFrame, embedder: Embedder, batch: int = 64, strict: bool = True) -> DataFrame:
    """``rows`` with Vector computed from Content, a bounded number of texts at a time.

    Unless ``strict``, texts of a batch that the model refuses are tried one by one, and
    those that fail stay without a vector.
    """

    def one_by_one(texts: list[str]) -> list[list[float] | None]:
        out: list[list[float] | None] = []
        for text in texts:
            try:
                out += embedder.embed([text], "RETRIEVAL_DOCUMENT")
            except Exception:
                out.append(None)
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            vectors: list[list[float] | None] = []
            texts = frame["Content"].fillna("").tolist()
            for start in range(0, len(texts), batch):
                part = texts[start : start + batch]
                try:
                    vectors += embedder.embed(part, "RETRIEVAL_DOCUMENT")
                except Exception:
                    if strict:
                        raise
                    vectors += one_by_one(part)
            yield frame.assign(Vector=vectors)

    return rows.mapInPandas(run, rows.schema)


def backfilled(rows: DataFrame, embedder: Embedder, batch: int = 64) -> DataFrame:
    """Rows without a vector whose id starts with two hexadecimal digits, embedded, with their shard.

    Rows are dealt by their whole id, so tasks are as many as the cluster wants and alike
    in size. Rows that the model refuses come back without a vector.
    """
    waiting = rows.where(F.col("Vector").isNull() & F.col("Id").rlike("^[0-9a-f]{2}"))
    return embedded(waiting.repartition("Id"), embedder, batch, strict=False).withColumn("shard", F.substring("Id", 1, 2))


def shard_report(done: DataFrame) -> DataFrame:
    """``shard, processed, failed`` of a backfill."""
    return done.groupBy("shard").agg(F.count("Vector").alias("processed"), F.count_if(F.col("Vector").isNull()).alias("failed"))


def merged(target: DataFrame, source: DataFrame, key: str = "Id") -> DataFrame:
    """The target without the source's keys, and the source."""
    return target.join(source.select(key), key, "left_anti").select(target.columns).unionByName(source.select(target.columns))


def without_machine(rows: DataFrame, machine: str) -> DataFrame:
    """Rows of other machines; those without a machine stay."""
    return rows.where(~F.col("MachineId").eqNullSafe(F.lit(machine)))


def _live(state: dict) -> Column:
    """True for index entries whose folder the state names for their bucket."""
    names = F.create_map(*(F.lit(x) for k, name in state["buckets"].items() for x in (int(k), name)))
    return F.try_element_at(names, F.col("bucket")) == F.col("folder")


class ChunkTable:
    """A versioned chunk table below ``path``, which may be on any store that Spark writes."""

    #: Folders of the inverted index by token, and times that a write is repeated after another's.
    SLOTS, TRIES = 16, 8
    #: Bytes of files whose rows, and then their postings, one task holds at a time.
    PIECE_BYTES = 4 << 20
    POSTINGS = "token string, bucket int, block int, n long, most long, density double, posts array<struct<Id: string, tf: long, dl: int>>, folder string, slot int"
    TOTALS = "bucket int, n long, tokens long, folder string"
    LEAVES = "Id string, ChunkType string, SessionId string, ProjectName string, MachineId string, Vector array<float>, leaf int, code binary, bucket int, folder string"

    def __init__(self, spark: SparkSession, path: str, dimension: int = DIMENSION, buckets: int = 64):
        self.spark, self.path, self.dimension, self.buckets = spark, path.rstrip("/"), dimension, buckets
        self.versions = Versions(spark, f"{self.path}/states")
        self._sample: tuple[int, float] | None = None
        self._tree: tuple[str, tree.Tree] | None = None

    # state -----------------------------------------------------------------
    def state(self) -> dict:
        state = self.versions.latest()[1]
        if state is None:
            raise FileNotFoundError(f"no table in {self.path}")
        return state

    def version(self) -> int | None:
        """The number of the table's state."""
        number, state = self.versions.latest()
        return None if state is None else number

    def initialize(self) -> None:
        """Create an empty table; does nothing if there is one."""
        number, state = self.versions.latest()
        if state is None:
            try:
                self.versions.commit(number, {"count": self.buckets, "buckets": {}, "index": None})
            except Conflict:
                pass  # another made it

    def _bucket(self, state: dict, id_col: str = "Id") -> Column:
        return F.pmod(F.xxhash64(id_col), F.lit(state["count"])).cast("int")

    def _rows(self, state: dict, only: set[int] | None = None) -> DataFrame:
        folders = [f"{self.path}/data/{name}/bucket={k}" for k, name in state["buckets"].items() if only is None or int(k) in only]
        return self.spark.read.schema(CHUNK).parquet(*folders) if folders else self.spark.createDataFrame([], CHUNK)

    def read(self) -> DataFrame:
        return self._rows(self.state())

    def lookup(self, ids: list[str]) -> DataFrame:
        """The rows of a few ids; only their buckets are read."""
        state = self.state()
        found = self.spark.createDataFrame([(x,) for x in ids], "Id string").select(self._bucket(state).alias("b")).distinct().collect()
        return self._rows(state, {r["b"] for r in found}).where(F.col("Id").isin(ids))

    def _parts(self, rows: DataFrame, buckets: int) -> int:
        """Pieces of each of ``buckets`` by the size of the files that ``rows`` come from."""
        jvm = self.spark._jvm
        folders = {f.rpartition("/")[0] for f in rows.inputFiles()}
        size = sum(self.versions.fs.getContentSummary(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f))).getLength() for f in folders)
        return max(1, -(-size // (buckets * self.PIECE_BYTES)))

    @staticmethod
    def _dealt(rows: DataFrame, tasks: int, many: bool, *keys: str) -> DataFrame:
        """``rows`` by keys; of ``many`` pieces Spark doesn't put tasks together again, as their rows grow when they are split."""
        return rows.repartition(tasks, *keys) if many else rows.repartition(*keys)

    def _write(self, number: int, state: dict, rows: DataFrame, touched: set[int]) -> None:
        """Commit ``rows`` as all that the touched buckets hold."""
        name = f"d-{uuid.uuid4().hex}"
        # a bucket is dealt to as many pieces as its size wants; blocks of documents lie within a piece
        parts = self._parts(rows, len(touched))
        piece = (F.col("bucket") * parts + F.pmod(F.xxhash64("Id", F.lit(1)), F.lit(parts))).cast("int")
        pieces = rows.select([f.name for f in CHUNK.fields]).withColumn("bucket", self._bucket(state)).withColumn("piece", piece)
        dealt = fulltext.numbered(self._dealt(pieces, parts * len(touched), parts > 1, "piece"), bucket="piece")
        dealt = dealt.withColumn("block", (F.col("block") * parts + F.pmod("piece", F.lit(parts))).cast("int")).drop("piece")
        dealt.sortWithinPartitions("bucket", "ProjectPath", "Timestamp").write.partitionBy("bucket").parquet(f"{self.path}/data/{name}")
        # the indexes are made from what was written
        written = self.spark.read.schema(f"{dealt.drop('bucket').schema.toDDL()}, bucket int").parquet(f"{self.path}/data/{name}")
        folder = F.lit(name).alias("folder")
        blocks = self._dealt(written.select("bucket", "block", "Id", "dl", "Content"), parts * len(touched), parts > 1, "bucket", "block")
        postings = fulltext.posting_blocks(blocks).withColumn("slot", F.pmod(F.xxhash64("token"), F.lit(self.SLOTS)).cast("int"))
        postings.sortWithinPartitions("slot", "token", F.desc("density")).write.partitionBy("slot").parquet(f"{self.path}/text/folder={name}")
        totals = written.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("dl").cast("long").alias("tokens")).select("*", folder)
        totals.coalesce(1).write.parquet(f"{self.path}/totals/{name}")
        if state["index"]:
            self._write_leaves(state["index"], written, name)
        present = {r["bucket"] for r in self.spark.read.schema(self.TOTALS).parquet(f"{self.path}/totals/{name}").collect()}
        kept = {k: v for k, v in state["buckets"].items() if int(k) not in touched}
        self.versions.commit(number, state | {"buckets": kept | {str(k): name for k in sorted(present)}})

    def _change(self, make) -> int:
        """Commit what ``make`` returns of the newest state: rows, touched buckets and a number; again after a conflict."""
        for _ in range(self.TRIES):
            number, state = self.versions.latest()
            if state is None:
                raise FileNotFoundError(f"no table in {self.path}")
            rows, touched, affected = make(state)
            if not touched:
                return affected
            try:
                self._write(number, state, rows, touched)
            except Conflict:
                continue
            return affected
        raise Conflict(f"{self.path} keeps being changed by others")

    def vacuum(self) -> None:
        """Delete the folders that no kept state names, and batches; for when no writer is at work."""
        fs, jvm = self.versions.fs, self.spark._jvm
        states = self.versions.kept()
        named = {name for s in states for name in s["buckets"].values()} | {s["index"] for s in states if s["index"]}
        parts = ["data", "text", "totals", "index", *(f"index/{s}" for s in {s["index"] for s in states if s["index"]})]
        for part in parts:
            where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
            for found in fs.listStatus(where) if fs.exists(where) else []:
                if (name := found.getPath().getName().removeprefix("folder=")) not in named and name != "model":
                    fs.delete(found.getPath(), True)
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/batches"), True)

    # writes ----------------------------------------------------------------
    def validate(self, chunks: DataFrame) -> None:
        """Raise if any row breaks a bound; one bad row rejects the batch."""
        bad = chunks.withColumn("errors", chunk_errors(self.dimension)).where(F.size("errors") > 0).select("Id", "errors").limit(5).collect()
        if bad:
            raise InvalidChunks("; ".join(f"{r['Id']}: {', '.join(r['errors'])}" for r in bad))

    def _kept(self, rows: DataFrame) -> DataFrame:
        """``rows`` written aside and read again, so that every use sees the same."""
        folder = f"{self.path}/batches/{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        return self.spark.read.schema(rows.schema).parquet(folder)

    def upsert(self, chunks: DataFrame, mode: str = "deferred", embedder: Embedder | None = None, order: str | None = None) -> int:
        """Insert or replace by Id. Returns the number of rows.

        Of repeated ids the last counts: by the column ``order``, or else as the rows
        stand in ``chunks`` when they are first read, which happens once. Batches are all
        with vectors, or all without: then ``remote_model`` embeds them, and ``deferred``
        keeps a stored vector whose content hasn't changed.
        """
        place = F.col(order) if order else F.monotonically_increasing_id()
        rows = self._kept(normalized(chunks.withColumn("_order", place), keep=("_order",)))
        self.validate(rows)
        columns = [f.name for f in CHUNK.fields]
        # whole rows are only dealt by id where one is repeated
        repeated = rows.groupBy("Id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        latest = (logs.last_wins(rows, ["Id"], ["_order"]) if repeated else rows).select(columns)
        sizes = latest.agg(F.count("*").alias("n"), F.count("Vector").alias("v")).first()
        if sizes["n"] == 0:
            raise InvalidChunks("the batch is empty")
        if 0 < sizes["v"] < sizes["n"]:
            raise InvalidChunks("the batch mixes rows with and without vectors")
        keep_vectors = sizes["v"] == 0 and mode == "deferred"
        if sizes["v"] == 0 and mode == "remote_model":
            if embedder is None:
                raise InvalidChunks("no embedder")
            latest = self._kept(embedded(latest, embedder))
        elif sizes["v"] == 0 and mode != "deferred":
            raise InvalidChunks(f"unknown mode {mode}")

        def make(state: dict):
            touched = {r["b"] for r in latest.select(self._bucket(state).alias("b")).distinct().collect()}
            target, new = self._rows(state, touched), latest
            if keep_vectors:
                # of what is stored, vectors and digests of texts are joined; the texts stay where they are
                old = target.where(F.col("Vector").isNotNull()).select(F.col("Id").alias("_id"), F.sha2("Content", 256).alias("_digest"), F.col("Vector").alias("_vector"))
                joined = latest.join(old, latest.Id == old._id, "left")
                new = joined.withColumn("Vector", F.when(F.sha2("Content", 256) == F.col("_digest"), F.col("_vector"))).select(columns)
            return merged(target, new), touched, sizes["n"]

        return self._change(make)

    def delete_machine(self, machine: str) -> int:
        machine = machine.strip()
        if not 1 <= len(machine.encode()) <= 256:
            raise ValueError("machine id must have 1 to 256 bytes")

        def make(state: dict):
            hit = self._rows(state).where(F.col("MachineId") == machine).groupBy(self._bucket(state).alias("b")).count().collect()
            touched = {r["b"] for r in hit}
            return without_machine(self._rows(state, touched), machine), touched, sum(r["count"] for r in hit)

        return self._change(make)

    def clear(self) -> int:
        def make(state: dict):
            return self.spark.createDataFrame([], CHUNK), {int(k) for k in state["buckets"]}, self._rows(state).count()

        return self._change(make)

    def backfill(self, embedder: Embedder, batch: int = 64) -> DataFrame:
        """Embed rows without a vector; returns the report by shard. Rows whose text changed meanwhile wait for the next."""
        done = self._kept(backfilled(self.read(), embedder, batch))
        ready = done.where("Vector IS NOT NULL").select("Id", F.col("Content").alias("_content"), F.col("Vector").alias("_vector"))

        def make(state: dict):
            touched = {r["b"] for r in ready.select(self._bucket(state).alias("b")).distinct().collect()}
            rows = self._rows(state, touched).join(ready, "Id", "left")
            vector_ = F.coalesce("Vector", F.when(F.col("Content") == F.col("_content"), F.col("_vector")))
            return rows.withColumn("Vector", vector_), touched, 0

        self._change(make)
        return shard_report(done)

    # indexes ---------------------------------------------------------------
    def search_text(self, query: str, k: int, where: Column | None = None) -> DataFrame:
        """``Id, Score, Distance`` by BM25 from the stored posting blocks, of which only those are read that can count."""
        state = self.state()
        names, wanted = sorted(set(state["buckets"].values())), fulltext.query_tokens(query)
        if not names or not wanted:
            return self.spark.createDataFrame([], "Id string, Score double, Distance double")
        slots = [r["s"] for r in self.spark.createDataFrame([(t,) for t in wanted], "token string").select(F.pmod(F.xxhash64("token"), F.lit(self.SLOTS)).alias("s")).distinct().collect()]
        postings = self.spark.read.schema(self.POSTINGS).option("basePath", f"{self.path}/text").parquet(*(f"{self.path}/text/folder={n}" for n in names))
        totals = self.spark.read.schema(self.TOTALS).parquet(*(f"{self.path}/totals/{n}" for n in names)).where(_live(state))
        stats = totals.agg(F.sum("n").alias("n"), (F.sum("tokens") / F.sum("n")).alias("avgdl"))
        allowed = None if where is None else self._rows(state).where(where).select("Id")
        return fulltext.BlockSearch(postings.where(F.col("slot").isin(slots)).where(_live(state)), stats, query, k, allowed, ("folder", "bucket", "block")).top()

    def optimize(self, leaves: int = 1000) -> bool:
        """Build the vector index once the table is large enough; later writes keep it up."""
        rows = self.read()
        if rows.where(F.col("Vector").isNotNull()).limit(vector.BUILD_THRESHOLD).count() < vector.BUILD_THRESHOLD:
            return False
        index = f"i-{uuid.uuid4().hex}"
        tree.train(rows, leaves).save(self.spark, f"{self.path}/index/{index}/model")
        done: set[str] = set()
        for _ in range(self.TRIES):
            number, state = self.versions.latest()
            for name in sorted(set(state["buckets"].values()) - done):
                written = self.spark.read.schema(f"{self.spark.createDataFrame([], CHUNK).schema.toDDL()}, bucket int").parquet(f"{self.path}/data/{name}")
                self._write_leaves(index, written, name)
                done.add(name)
            try:
                self.versions.commit(number, state | {"index": index})
                return True
            except Conflict:
                continue
        raise Conflict(f"{self.path} keeps being changed by others")

    def _model(self, index: str) -> tree.Tree:
        if not self._tree or self._tree[0] != index:
            self._tree = (index, tree.Tree.load(self.spark, f"{self.path}/index/{index}/model"))
        return self._tree[1]

    def _write_leaves(self, index: str, written: DataFrame, name: str) -> None:
        rows = tree.assigned(written, self._model(index), (*vector.STORED, "bucket"))
        rows.withColumn("folder", F.lit(name)).sortWithinPartitions("leaf").write.parquet(f"{self.path}/index/{index}/{name}")

    def leaves(self) -> tuple[DataFrame, tree.Tree] | None:
        """The vector index's entries for the table as it is, and its tree; None where there is none."""
        state = self.state()
        index, names = state["index"], sorted(set(state["buckets"].values()))
        if not index or not names:
            return None
        entries = self.spark.read.schema(self.LEAVES).parquet(*(f"{self.path}/index/{index}/{n}" for n in names))
        return entries.where(_live(state)), self._model(index)

    def stats(self, now: float) -> dict:
        row = summaries.store_stats(self.read()).first().asDict()
        out = row | summaries.progress(self._sample, row["embedded"], row["awaiting"], now)
        self._sample = (row["embedded"], now)
        return out
