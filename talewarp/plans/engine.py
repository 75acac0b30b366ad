"""The engine: search, file search, sessions, status, and the five tools."""

from __future__ import annotations

import json
import math
import threading
import time
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_text
from ..operators import hybrid, summaries, tree, vector
from ..operators import text as fulltext
from ..operators.filters import Filter
from ..schema import RESULT_COLUMNS, vector_error
from ..table import ChunkTable, Embedder
from ..streaming.forward import KeyedState
from .requests import LIMITS, MAX_RESPONSE_BYTES, InvalidRequest, Request, choose_mode, decode

DEADLINE_SECONDS, STATS_SECONDS = 60, 30
#: Wire name of each result column.
WIRE = {"Id": "id", "Content": "content", "ChunkType": "chunk_type", "SessionId": "session_id", "ProjectPath": "project_path", "ProjectName": "project_name", "Timestamp": "timestamp", "FilePath": "file_path", "Operation": "operation", "SourceFile": "source_file", "Distance": "distance", "SearchType": "search_type"}
#: Kind of request of each tool that searches.
KINDS = {"search_conversations": "search", "search_file_changes": "files", "get_session_summaries": "sessions", "get_session_summary": "sessions"}
TOOLS = ("search_conversations", "search_file_changes", "get_session_summaries", "get_status", "get_health")


#: Wire names that no result may lack.
REQUIRED = ("id", "content", "chunk_type", "session_id", "project_path", "project_name", "timestamp", "source_file", "search_type")


class InvalidResult(ValueError):
    """A row of a result that breaks the contract."""


class DeadlineExceeded(TimeoutError):
    """A request that ran longer than its deadline."""


class Engine:
    def __init__(self, table: ChunkTable, embedder: Embedder, full_text: bool = True, candidates: int = hybrid.CANDIDATES, rrf_k: int = hybrid.RRF_K, probes: int | None = None):
        self.table, self.embedder, self.full_text = table, embedder, full_text
        self.candidates, self.rrf_k, self.probes = candidates, rrf_k, probes
        self._stats: tuple[float, int | None, dict] | None = None
        self._lock = threading.Lock()

    def optimize(self, leaves: int = 1000) -> bool:
        """Build the vector index if the table is large enough."""
        return self.table.optimize(leaves)

    def query_vector(self, text: str) -> list[float]:
        found = self.embedder.embed([text], "RETRIEVAL_QUERY")
        if len(found) != 1 or len(found[0]) != self.embedder.dimension:
            raise InvalidRequest("the model must give one vector of the table's dimension")
        bad = self.table.spark.range(1).select(vector_error(F.array(*map(F.lit, found[0])), self.embedder.dimension)).first()[0]
        if bad:
            raise InvalidRequest(bad)
        return found[0]

    def vector_search(self, request: Request, limit: int | None = None) -> DataFrame:
        """The nearest chunks; filters come before the top-k on either path."""
        index = self.table.leaves()
        mode = choose_mode(request.mode, request.where, index is not None)
        query, k = self.query_vector(request.query), limit or request.limit
        if mode == "exact":
            top = vector.exact_topk(self.table.read(), query, k, request.where.column())
            return top.select(*RESULT_COLUMNS, "Distance", F.lit("exact").alias("SearchType"))
        rows, model = index
        share = self.probes / len(model) if self.probes else tree.VISITED
        top = tree.topk(rows, model, query, k, share, request.where.column()).select("Id", "Distance")
        return hybrid.late_materialized(top, self.table.read(), RESULT_COLUMNS).select(*RESULT_COLUMNS, "Distance", F.lit("ann").alias("SearchType")).orderBy("Distance", "Id")

    def text_search(self, request: Request) -> DataFrame:
        if not self.full_text:
            raise InvalidRequest("full-text search is disabled")
        top = self._said(request, request.limit).select("Id", "Distance")
        return hybrid.late_materialized(top, self.table.read(), RESULT_COLUMNS).select(*RESULT_COLUMNS, "Distance", F.lit("full_text").alias("SearchType")).orderBy("Distance", "Id")

    def _said(self, request: Request, k: int) -> DataFrame:
        """The best chunks by text, from the table's inverted index."""
        return self.table.search_text(request.query, k, None if request.where == Filter() else request.where.column())

    def hybrid_search(self, request: Request) -> DataFrame:
        """Vector and text candidates, fused by rank."""
        n = max(request.limit, self.candidates)
        near = self.vector_search(request, n)
        said = self._said(request, n)
        top = hybrid.fuse([hybrid.ranked(near, "Distance", "Id"), hybrid.ranked(said, F.desc("Score"), "Id")], request.limit, self.rrf_k)
        return hybrid.late_materialized(top, self.table.read(), RESULT_COLUMNS).select(*RESULT_COLUMNS, "Distance", F.lit("hybrid").alias("SearchType")).orderBy("Distance", "Id")

    def search(self, body: bytes | str) -> dict:
        """Hybrid search, falling back to vectors if it fails for another reason than time."""
        request = decode(body, "search")
        if not (request.hybrid and self.full_text and fulltext.query_tokens(request.query)):
            return self._run(lambda: self.vector_search(request))
        try:
            return self._run(lambda: self.hybrid_search(request))
        except (DeadlineExceeded, InvalidRequest):
            raise
        except Exception:
            return self._run(lambda: self.vector_search(request))

    def search_files(self, body: bytes | str) -> dict:
        request = decode(body, "files")
        return self._run(lambda: self.vector_search(request))

    def sessions(self, body: bytes | str) -> dict:
        request = decode(body, "sessions")

        def latest() -> DataFrame:
            rows = self.table.read()
            return summaries.latest_per_session(rows, request.limit, request.where.column()).select(*RESULT_COLUMNS, "Distance", F.lit("recent").alias("SearchType"))

        return self._run(latest)

    def _run(self, build) -> dict:
        """Collect a short result within the deadline and the response bound."""
        context = self.table.spark.sparkContext
        group, expired = f"request-{uuid.uuid4().hex}", threading.Event()

        def stop() -> None:
            expired.set()
            context.cancelJobGroup(group)

        timer = threading.Timer(DEADLINE_SECONDS, stop)
        context.setJobGroup(group, "retrieval", interruptOnCancel=True)
        timer.start()
        try:
            rows = checked([r.asDict() for r in wire(build()).collect()])
        except Exception as error:
            if expired.is_set():
                raise DeadlineExceeded(f"no result within {DEADLINE_SECONDS} s") from error
            raise
        finally:
            timer.cancel()
            context.setLocalProperty("spark.jobGroup.id", None)
        answer = {"results": rows, "count": len(rows), "search_type": rows[0]["search_type"] if rows else "empty"}
        if len(json.dumps(answer, ensure_ascii=False).encode()) > MAX_RESPONSE_BYTES:
            raise InvalidRequest("the response is too large")
        return answer

    def status(self, now: float | None = None, queue: KeyedState | None = None) -> dict:
        """Statistics, kept for a while unless the table changes, and the number of items that wait in ``queue``."""
        now = time.time() if now is None else now
        with self._lock:
            try:
                version = self.table.version()
                if not self._stats or self._stats[1] != version or now - self._stats[0] > STATS_SECONDS:
                    self._stats = (now, version, self.table.stats(now))
                return {"available": True, "error": None, "queue_depth": queue.rows().count() if queue else 0, **self._stats[2]}
            except Exception as error:
                return {"available": False, "error": str(error)[:200]}

    def ready(self, watcher_ready: bool | None = None) -> bool:
        """The table can be read, and the watcher (if there is one) is ready."""
        try:
            self.table.read().select("Id").limit(1).count()
        except Exception:
            return False
        return watcher_ready is not False

    def call_tool(self, name: str, arguments: dict) -> dict:
        """One of the five tools, with arguments normalised to a request."""
        if name in ("search_conversations", "search_file_changes", "get_session_summaries", "get_session_summary"):
            body = json.dumps(tool_request(name, arguments))
            run = self.search if name == "search_conversations" else self.search_files if name == "search_file_changes" else self.sessions
            return run(body)
        if name in ("get_status", "get_index_status"):
            if arguments:
                raise InvalidRequest(f"{name} takes no arguments")
            return self.status()
        if name in ("get_health", "get_server_status"):
            if set(arguments) - {"detail_level"} or arguments.get("detail_level", "basic") not in ("basic", "full"):
                raise InvalidRequest("detail_level must be basic or full")
            return {"ready": self.ready()} | (self.status() if arguments.get("detail_level") == "full" else {})
        raise InvalidRequest(f"unknown tool {name!r}")


#: Arguments of each tool: the request's field, and what the value must be.
ARGUMENTS = {
    "search_conversations": {"query": ("query", str), "project_filter": ("project_path", str), "date_from": ("date_from", str), "date_to": ("date_to", str), "limit": ("limit", int), "use_hybrid": ("use_hybrid", bool), "enable_analysis": ("enable_analysis", bool), "enable_synthesis": ("enable_synthesis", bool), "include_debug": ("include_debug", bool)},
    "search_file_changes": {"file_path": ("file_path", str), "query": ("query", str), "project_filter": ("project_path", str), "operation_filter": ("operation", str), "date_from": ("date_from", str), "date_to": ("date_to", str), "limit": ("limit", int)},
    "get_session_summaries": {"session_id": ("session_id", str), "project_filter": ("project_path", str), "count": ("limit", int)},
}
ARGUMENTS["get_session_summary"] = ARGUMENTS["get_session_summaries"]


def tool_request(name: str, arguments: dict) -> dict:
    """A tool's arguments as a request: null text is absent, numbers are whole and within the tool's limit, flags are flags.

    Names of the request's own fields are taken as they are.
    """
    known, out = ARGUMENTS[name], {}
    own = {field: kind for field, kind in known.values()}
    for key, value in arguments.items():
        field, kind = known.get(key) or (key, own.get(key, str))
        if value is None and kind is str:
            continue
        whole = isinstance(value, float) and value.is_integer() and kind is int
        if not whole and (not isinstance(value, kind) or (kind is int and isinstance(value, bool))):
            raise InvalidRequest(f"{key} isn't valid")
        if field == "operation" and value not in ("edit", "write"):
            raise InvalidRequest("operation must be edit or write")
        if field == "limit" and not 1 <= value <= LIMITS[KINDS[name]][0]:
            raise InvalidRequest(f"{key} must be 1 to {LIMITS[KINDS[name]][0]}")
        if value != "":
            out[field] = int(value) if kind is int else value
    if name == "search_file_changes" and "query" not in out and "file_path" not in out:
        out["query"] = "file changes modifications edits"
    return out


def checked(rows: list[dict]) -> list[dict]:
    """Results, if each has what it must have and a finite distance; raises InvalidResult otherwise."""
    for row in rows:
        missing = [name for name in REQUIRED if not row[name]]
        if missing or row["distance"] is None or not math.isfinite(row["distance"]):
            raise InvalidResult(f"bad result row {row['id']!r}: {', '.join(missing) or 'distance'}")
    return rows


def wire(rows: DataFrame) -> DataFrame:
    """Results under their wire names, with null text as empty and times in RFC 3339."""
    out = []
    for column, name in WIRE.items():
        if column == "Timestamp":
            stamp = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
            col = F.concat(F.regexp_replace(stamp, r"\.?0+$", ""), F.lit("Z"))
            whole = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
            col = F.when(F.pmod(F.unix_micros(column), F.lit(1_000_000)) == 0, F.concat(whole, F.lit("Z"))).otherwise(col)
        elif column == "Distance":
            col = F.col(column)
        else:
            col = first_text(F.col(column))
        out.append(col.alias(name))
    return rows.select(out)


__all__ = ["Engine", "DeadlineExceeded", "TOOLS"]
