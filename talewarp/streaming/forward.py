"""Forward-only ingestion: new transcript files into the chunk table, once each change.

At the first start the present files are excluded and a cutoff is kept. Each tick lists
the files, leaves out excluded ones and those whose size and time, or digest, are known,
judges the rest by their records' times, and upserts the chunks of accepted files. Only
files that changed are read, ``MAX_FILES`` at a time until none is left; their names come
to the driver, contents don't. A file that changes while it is read waits for the next
tick. Roots are folders of this host and listed by the
driver. State lives in Parquet tables next to the chunk table; the chunks are committed
before the state, and upserts are idempotent, so a tick that dies is simply run again.
"""

from __future__ import annotations

import json
import os
import stat
import time
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.files import source_kind
from ..functions.text import stem
from ..operators import logs
from ..sources import registry
from ..sources.common import MAX_FILES, MAX_SNAPSHOT_BYTES
from ..table import ChunkTable, Embedder
from ..versions import Conflict, Versions

#: Seconds after which a tick begins no further batch.
SCAN_SECONDS = 60.0
#: Sessions that name no conversation, and so are never excluded.
SYNTHETIC = ["unknown", "gemini-session", "gemini-logs"]
#: Sources whose files hold many conversations.
EXPORTS = ("chatgpt", "claudeapp")
STATE = {"excluded": "path string, object string, session string, reason string", "progress": "path string, digest string, bytes long, modified long, status string", "meta": "name string, value string"}


def listed(path: str) -> tuple[str, str, int, int] | None:
    """``path, object, bytes, modified`` (nanoseconds) of a regular file; None for what isn't one.

    Symbolic links and files with several names don't count. The object (device and
    inode) tells a file that was renamed from a new one.
    """
    try:
        found = os.lstat(path)
    except FileNotFoundError:
        return None
    if not stat.S_ISREG(found.st_mode) or found.st_nlink != 1 or found.st_size > MAX_SNAPSHOT_BYTES:
        return None
    return path, f"{found.st_dev}:{found.st_ino}", found.st_size, found.st_mtime_ns


def listing(root: str) -> list[tuple[str, str, int, int]]:
    """The files below a root on this host, as ``listed`` has them."""
    out = []
    for folder, dirs, names in os.walk(root, followlinks=False):
        dirs.sort()
        out += filter(None, (listed(os.path.join(folder, name)) for name in sorted(names)))
    return out


def root_object(root: str) -> str:
    """Device and inode of a root; raises where it is no folder."""
    if not os.path.isdir(root):
        raise FileNotFoundError(f"no root {root}")
    found = os.stat(root)
    return f"{found.st_dev}:{found.st_ino}"


def path_session(path):
    """The session that a path names: after ``brain``, before ``subagents``, or a UUID in the file's name."""
    uuid_pattern = r"(?i)([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})"
    found = [F.regexp_extract(path, rf"{uuid_pattern}/subagents/", 1), F.regexp_extract(path, rf"/brain/{uuid_pattern}/", 1), F.regexp_extract(stem(path), uuid_pattern, 1)]
    return F.lower(F.coalesce(*(F.nullif(x, F.lit("")) for x in found)))


class ForwardIngest:
    def __init__(self, spark: SparkSession, roots: list[str], table: ChunkTable, state: str, machine: str = "", embedder: Embedder | None = None):
        self.spark, self.roots, self.table = spark, roots, table
        self.state, self.machine, self.embedder = state.rstrip("/"), machine, embedder
        self.ready = False

    # state -----------------------------------------------------------------
    def _read(self, name: str) -> DataFrame:
        """All parts of a state table; parts are added, never changed."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.state}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], STATE[name])
        return self.spark.read.schema(STATE[name]).parquet(f"{self.state}/{name}")

    def _append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.state}/{name}")

    def _progress(self) -> DataFrame:
        """Size, time and digest of every version of a file that was handled."""
        return self._read("progress").distinct()

    def cutoff(self) -> datetime | None:
        row = self._read("meta").where("name = 'cutoff'").orderBy("value").first()
        return datetime.fromisoformat(row["value"]) if row else None

    def _listed(self) -> DataFrame:
        rows = [x for r in self.roots for x in listing(r)]
        frame = self.spark.createDataFrame(rows, "path string, object string, bytes long, modified long")
        return registry.routed(frame)

    def _kept_roots(self) -> dict[str, str]:
        """The object of each root as last kept."""
        rows = self._read("meta").where("name = 'root_object'").collect()
        return {path: kept for _, path, kept in sorted(json.loads(r["value"]) for r in rows)}

    def _keep_roots(self, objects: dict[str, str]) -> None:
        rows = [("root_object", json.dumps([time.time(), path, kept])) for path, kept in objects.items()]
        self._append("meta", self.spark.createDataFrame(rows, STATE["meta"]))

    def _reconcile(self) -> None:
        """Hold the roots against the kept ones.

        A root that is missing, left out or another folder than before is an error. Where
        only the device's number changed, exclusions are kept under the new one too.
        """
        now = {r: root_object(r) for r in self.roots}
        moved = {}
        for path, old in self._kept_roots().items():
            if path not in now:
                raise ValueError(f"root {path} is left out")
            if now[path].split(":")[1] != old.split(":")[1]:
                raise ValueError(f"root {path} is another folder than before")
            if now[path] != old:
                moved[path] = now[path]
                device, renamed = old.split(":")[0], now[path].split(":")[0]
                held = self._read("excluded").where(F.substring_index("object", ":", 1) == device)
                number = F.concat(F.lit(f"{renamed}:"), F.substring_index("object", ":", -1))
                self._append("excluded", held.withColumn("object", number))
        if moved:
            self._keep_roots(moved)

    def start(self, now: datetime | None = None) -> None:
        """Keep the cutoff and exclude what is there, before anything is written; once.

        A root that is new is treated so when it first appears.
        """
        self._reconcile()
        known = {r["value"] for r in self._read("meta").where("name = 'root'").collect()}
        fresh = [r for r in self.roots if r not in known]
        if self.cutoff() is None or fresh:
            here = self._listed().where(" OR ".join(f"startswith(path, '{r.rstrip('/')}/')" for r in fresh) if fresh else "false")
            self._append("excluded", here.select("path", "object", path_session(F.col("path")).alias("session"), F.lit("baseline").alias("reason")))
            meta = [("root", r) for r in fresh]
            if self.cutoff() is None:
                meta.append(("cutoff", (now or datetime.now(UTC)).isoformat()))
            self._append("meta", self.spark.createDataFrame(meta, STATE["meta"]))
        if new := {r: root_object(r) for r in self.roots if r not in self._kept_roots()}:
            self._keep_roots(new)

    # one tick --------------------------------------------------------------
    def tick(self, budget: float = SCAN_SECONDS) -> dict[str, int]:
        """One pass over the roots; returns the number of changed files by outcome.

        After ``budget`` seconds no further batch is begun; its files wait for the next tick.
        """
        until = time.monotonic() + budget
        cutoff = self.cutoff()
        if cutoff is None:
            raise RuntimeError("start() comes first")
        self._reconcile()
        excluded, progress = self._read("excluded"), self._progress()
        files = self._listed().withColumn("session", path_session(F.col("path")))
        for key in ("path", "object", "session"):
            files = files.join(excluded.select(key).where(f"{key} IS NOT NULL").distinct(), key, "left_anti")
        # what has a known size and time isn't read
        changed = files.join(progress.select("path", "bytes", "modified"), ["path", "bytes", "modified"], "left_anti").cache()
        outcome = {"accepted": 0, "refused": 0, "waiting": 0}
        try:
            after = ""
            while part := changed.where(F.col("path") > after).orderBy("path").limit(MAX_FILES).collect():
                for name, number in self._batch(part, progress, cutoff).items():
                    outcome[name] += number
                after = part[-1]["path"]
                if time.monotonic() >= until:
                    break
        finally:
            changed.unpersist()
        self.ready = True
        return outcome

    def _batch(self, part: list[Row], progress: DataFrame, cutoff: datetime) -> dict[str, int]:
        """Ingest a bounded number of files: those of known content get their new time, the others are judged."""
        found = self._snapshot([r["path"] for r in part]).cache()
        try:
            digests = {r["path"]: r["digest"] for r in found.select("path", "digest").collect()}
            # a file that changed since it was listed is left to the next tick
            steady = {r["path"]: r for r in part if r["path"] in digests and listed(r["path"]) == (r["path"], r["object"], r["bytes"], r["modified"])}
            known = {(r["path"], r["digest"]) for r in progress.where(F.col("path").isin(list(steady))).select("path", "digest").collect()}
            same = [p for p in steady if (p, digests[p]) in known]
            if same:
                self._append("progress", self._progress_rows([steady[p] for p in same], digests, dict.fromkeys(same, "same")))
            fresh = [p for p in steady if (p, digests[p]) not in known]
            if not fresh:
                return {}
            return self._ingest(found.where(F.col("path").isin(fresh)), [steady[p] for p in fresh], digests, cutoff)
        finally:
            found.unpersist()

    def _progress_rows(self, files: list[Row], digests: dict[str, str], status: dict[str, str]) -> DataFrame:
        rows = [(r["path"], digests[r["path"]], r["bytes"], r["modified"], status[r["path"]]) for r in files]
        return self.spark.createDataFrame(rows, STATE["progress"])

    def _snapshot(self, names: list[str]) -> DataFrame:
        """``path, content, digest`` of files."""
        found = self.spark.read.format("binaryFile").load([f"file://{n}" for n in names])
        return found.select(F.regexp_replace("path", "^file:(?://)?(?=/)", "").alias("path"), "content", F.sha2("content", 256).alias("digest"))

    def _ingest(self, changed: DataFrame, files: list[Row], digests: dict[str, str], cutoff: datetime) -> dict[str, int]:
        chunks, issues = registry.all_chunks(changed.select("path", "content"), self.machine, only={r["kind"] for r in files})
        chunks, issues = chunks.cache(), issues.cache()
        try:
            return self._commit(chunks, issues, files, digests, cutoff)
        finally:
            chunks.unpersist()
            issues.unpersist()

    def _commit(self, chunks: DataFrame, issues: DataFrame, files: list[Row], digests: dict[str, str], cutoff: datetime) -> dict[str, int]:
        # a time within the first day after the epoch is a line number, so there was none
        timed = F.when(F.unix_seconds("Timestamp") >= 86_400, F.col("Timestamp"))
        rows = chunks.select(F.col("SourceFile").alias("path"), timed.alias("ts"), F.lit(False).alias("issue"), F.col("SessionId").alias("session"))
        rows = rows.unionByName(issues.select("path", F.lit(None).cast("timestamp").alias("ts"), F.lit(True).alias("issue"), F.lit(None).cast("string").alias("session")))
        # exports are judged by conversation, other files as a whole
        whole = ~F.coalesce(source_kind(F.col("path")).isin(*EXPORTS), F.lit(False))
        rows = rows.where(whole | ~F.col("issue")).withColumn("unit", F.when(whole, F.col("path")).otherwise(F.concat("path", F.lit("\n"), "session")))
        units = logs.eligibility(rows, "unit", "ts", F.lit(cutoff), ~F.col("issue"), F.col("issue")).select("unit", "status").cache()
        judged = units.select(F.substring_index("unit", "\n", 1).alias("path"), "status").groupBy("path").agg(F.collect_set("status").alias("states"))
        state = F.when(F.array_contains("states", "wait"), "wait").when(F.array_contains("states", "accept"), "accept").otherwise("refuse")
        judged = {r["path"]: r["status"] for r in judged.select("path", state.alias("status")).collect()}
        status = {r["path"]: judged.get(r["path"], "empty") for r in files}
        by = {s: [p for p, own in status.items() if own == s] for s in ("accept", "refuse", "wait", "empty")}
        own = chunks.withColumn("unit", F.when(~F.coalesce(source_kind(F.col("SourceFile")).isin(*EXPORTS), F.lit(False)), F.col("SourceFile")).otherwise(F.concat("SourceFile", F.lit("\n"), "SessionId")))
        accepted = own.join(units.where("status = 'accept'").select("unit"), "unit", "left_semi").drop("unit")
        old = self._read("excluded").select("session").where("session IS NOT NULL").distinct()
        accepted = accepted.join(old, F.lower("SessionId") == old.session, "left_anti")
        # chunks without a time of their own take the nearest one of their file, which isn't before the cutoff
        accepted = accepted.withColumn("Timestamp", F.when(F.unix_seconds("Timestamp") >= 86_400, F.col("Timestamp")))
        accepted = accepted.withColumn("Timestamp", logs.repaired_timestamp("Timestamp", F.lit(cutoff), ["SourceFile"], ["SourceLine", "Id"]))
        current = self.table.read().select("Id", F.sha2("Content", 256).alias("sha"))
        novel = accepted.withColumn("sha", F.sha2("Content", 256)).join(current, ["Id", "sha"], "left_anti").drop("sha")
        if novel.limit(1).count():
            self.table.upsert(novel, "remote_model" if self.embedder else "deferred", self.embedder)
        whole_files = [p for p in by["refuse"] if not p.endswith("conversations.json")]
        if whole_files:
            real = ~(F.col("SessionId").isin(SYNTHETIC) | F.col("SessionId").rlike("^[0-9]+$"))
            gone = chunks.where(F.col("SourceFile").isin(whole_files)).select(F.col("SourceFile").alias("path"), F.when(real, F.lower("SessionId")).alias("session")).distinct()
            objects = self.spark.createDataFrame([(r["path"], r["object"]) for r in files if r["path"] in whole_files], "path string, object string")
            kept = objects.join(gone, "path", "left")
            self._append("excluded", kept.select("path", "object", "session", F.lit("refused").alias("reason")))
        # a refused export isn't excluded: it may gain conversations, and is read again only if it changes
        # nor is a file that waits, which is read again when it changes
        done = [r for r in files if status[r["path"]] != "refuse" or r["path"].endswith("conversations.json")]
        if done:
            self._append("progress", self._progress_rows(done, digests, status))
        units.unpersist()
        return {"accepted": len(by["accept"]), "refused": len(by["refuse"]), "waiting": len(by["wait"])}

    # trigger ---------------------------------------------------------------
    def stream(self, interval: str = "1 second", checkpoint: str | None = None):
        """A streaming query whose clock runs a tick for each batch. A failed tick is retried at the next."""

        def run(_batch: DataFrame, _number: int) -> None:
            try:
                self.tick()
            except Exception as error:
                self.ready = False
                self.last_error = str(error)

        clock = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        return clock.writeStream.foreachBatch(run).trigger(processingTime=interval).option("checkpointLocation", checkpoint or f"{self.state}/clock").start()


class KeyedState:
    """Small keyed state (checkpoints, retry queue): at most ``capacity`` rows, written whole at each change.

    Changes are numbered states (``versions``), so of two writers the second starts again
    from the first one's rows, and no generation goes back.
    """

    SCHEMA = "key string, value string, generation long, attempts int, due double"

    def __init__(self, spark: SparkSession, path: str, capacity: int = 10_000):
        self.spark, self.path, self.capacity = spark, path.rstrip("/"), capacity
        self.versions = Versions(spark, f"{self.path}/states")

    def _at(self, state: dict | None) -> DataFrame:
        if not state:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/{state['folder']}")

    def rows(self) -> DataFrame:
        return self._at(self.versions.latest()[1])

    def _change(self, make) -> None:
        """Replace the rows by what ``make`` returns of them (None: leave them)."""
        for _ in range(8):
            number, state = self.versions.latest()
            new = make(self._at(state))
            if new is None:
                return
            folder = f"r-{uuid.uuid4().hex}"
            new.coalesce(1).write.parquet(f"{self.path}/{folder}")
            try:
                self.versions.commit(number, {"folder": folder})
            except Conflict:
                continue
            named, jvm = {s["folder"] for s in self.versions.kept()}, self.spark._jvm
            for found in self.versions.fs.listStatus(jvm.org.apache.hadoop.fs.Path(self.path)):
                name = found.getPath().getName()
                # others may be about to commit what they have just written
                if name.startswith("r-") and name not in named and time.time() - found.getModificationTime() / 1000 > 3600:
                    self.versions.fs.delete(found.getPath(), True)
            return
        raise Conflict(f"{self.path} keeps being changed by others")

    def _with(self, rows: DataFrame, key: str, value: str, generation: int, attempts: int, due: float) -> DataFrame:
        return rows.where(F.col("key") != key).unionByName(self.spark.createDataFrame([(key, value, generation, attempts, float(due))], self.SCHEMA))

    def get(self, key: str):
        return self.rows().where(F.col("key") == key).first()

    def put(self, key: str, value: str, generation: int) -> None:
        """A checkpoint; its generation must not go back."""

        def make(rows: DataFrame) -> DataFrame:
            old = rows.where(F.col("key") == key).first()
            if old and generation < old["generation"]:
                raise ValueError("the generation goes back")
            return self._with(rows, key, value, generation, 0, 0.0)

        self._change(make)

    def enqueue(self, key: str, value: str, now: float) -> None:
        """Add an item; the same item again does nothing, another under its key is a conflict."""

        def make(rows: DataFrame) -> DataFrame | None:
            old = rows.where(F.col("key") == key).first()
            if old:
                if old["value"] != value:
                    raise ValueError("another item has this key")
                return None
            if rows.count() >= self.capacity:
                raise ValueError("the queue is full")
            return self._with(rows, key, value, 0, 0, now)

        self._change(make)

    def due(self, now: float, limit: int) -> DataFrame:
        return self.rows().where(F.col("due") <= now).orderBy("key").limit(limit)

    def acknowledge(self, key: str) -> None:
        self._change(lambda rows: rows.where(F.col("key") != key))

    def retry(self, key: str, due: float) -> None:
        def make(rows: DataFrame) -> DataFrame | None:
            old = rows.where(F.col("key") == key).first()
            return self._with(rows, key, old["value"], old["generation"], old["attempts"] + 1, due) if old else None

        self._change(make)
