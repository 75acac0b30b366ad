"""Retrieval requests: decoding, limits, and the choice of access path."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from ..operators.filters import Filter, InvalidRequest, parse_bound

MAX_QUERY_RUNES, MAX_QUERY_BYTES = 10_000, 16_384
MAX_REQUEST_BYTES, MAX_RESPONSE_BYTES = 64 << 10, 8 << 20
#: Largest and default number of results by kind of request.
LIMITS = {"search": (50, 5), "files": (50, 10), "sessions": (20, 1)}
TEXT_FIELDS = {"project_path", "chunk_type", "session_id", "project_name", "machine_id", "operation", "file_path", "date_from", "date_to", "query", "mode"}
FLAGS = {"use_hybrid", "enable_analysis", "enable_synthesis", "include_debug"}
FILE_OPERATIONS = ("", "edit", "write")


@dataclass(frozen=True)
class Request:
    query: str
    limit: int
    where: Filter = field(default_factory=Filter)
    hybrid: bool = True
    mode: str = "auto"


def _no_repeats(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise InvalidRequest("a key is repeated")
    return out


def decode(body: bytes | str, kind: str) -> Request:
    """A request from JSON: one flat object with known keys only."""
    raw = body.encode() if isinstance(body, str) else body
    if len(raw) > MAX_REQUEST_BYTES:
        raise InvalidRequest("the request is too large")
    try:
        values = json.loads(raw, object_pairs_hook=_no_repeats)
    except (ValueError, RecursionError) as error:
        raise InvalidRequest(f"bad request: {error}") from error
    if not isinstance(values, dict):
        raise InvalidRequest("the request must be an object")
    for name, value in values.items():
        ok = isinstance(value, str) if name in TEXT_FIELDS else isinstance(value, bool) if name in FLAGS else name == "limit" and isinstance(value, int) and not isinstance(value, bool)
        if not ok:
            raise InvalidRequest(f"bad field {name!r}")
    most, default = LIMITS[kind]
    limit = values.get("limit", default) or default
    if not 1 <= limit <= most:
        raise InvalidRequest(f"limit must be 1 to {most}")
    where = {k: values.get(k, "") for k in ("project_path", "chunk_type", "session_id", "project_name", "machine_id", "operation", "file_path")}
    query = values.get("query", "")
    if kind == "files":
        if where["operation"] not in FILE_OPERATIONS:
            raise InvalidRequest("operation must be edit or write")
        where["chunk_type"] = "file_change"
        query = query or f"file changes to {where['file_path']}"
    if kind == "sessions":
        where = {k: v if k in ("session_id", "project_path") else "" for k, v in where.items()} | {"chunk_type": "summary"}
    elif not query.strip() or len(query) > MAX_QUERY_RUNES or len(query.encode()) > MAX_QUERY_BYTES:
        raise InvalidRequest("the query is blank or too long")
    filters = Filter(**where, date_from=parse_bound(values.get("date_from", "")), date_to=parse_bound(values.get("date_to", ""), end=True))
    filters.validate()
    return Request(query, limit, filters, kind == "search" and values.get("use_hybrid", True), values.get("mode", "auto"))


def choose_mode(mode: str, where: Filter, index_ready: bool) -> str:
    """``exact`` or ``ann``. Filters that the index doesn't store force exact search."""
    if mode not in ("auto", "exact", "ann"):
        raise InvalidRequest(f"unknown mode {mode!r}")
    covered = where.only_indexed()
    if mode == "ann" and not covered:
        raise InvalidRequest("the index doesn't store a filtered column")
    if mode == "ann" and not index_ready:
        raise InvalidRequest("the index isn't ready")
    return "ann" if mode != "exact" and covered and index_ready else "exact"
