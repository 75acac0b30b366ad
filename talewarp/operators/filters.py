"""Conjunctive filters of retrieval requests."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Column and byte limit of each equality filter.
EQUALITY = {
    "project_path": ("ProjectPath", 8192),
    "chunk_type": ("ChunkType", 32),
    "session_id": ("SessionId", 128),
    "project_name": ("ProjectName", 256),
    "machine_id": ("MachineId", 256),
    "operation": ("Operation", 32),
}
PATH_LIMIT = 8192
#: Filters that the vector index can answer from its own columns.
INDEXED = ("chunk_type", "session_id", "project_name", "machine_id")

_DATE = re.compile(r"\d{4}-\d\d-\d\d")
_INSTANT = re.compile(r"(\d{4}-\d\d-\d\d)T(\d\d:\d\d:\d\d)(?:\.(\d+))?(Z|[+-]\d\d:\d\d)")


class InvalidRequest(ValueError):
    """A request outside its limits."""


@dataclass(frozen=True)
class Filter:
    """Empty text and None mean that a predicate is absent; both time bounds are inclusive."""

    project_path: str = ""
    chunk_type: str = ""
    session_id: str = ""
    project_name: str = ""
    machine_id: str = ""
    operation: str = ""
    file_path: str = ""
    date_from: datetime | None = None
    date_to: datetime | None = None

    def validate(self) -> None:
        for name, (_, most) in {**EQUALITY, "file_path": ("FilePath", PATH_LIMIT)}.items():
            if len(getattr(self, name).encode()) > most:
                raise InvalidRequest(f"{name} exceeds {most} bytes")
        if self.date_from and self.date_to and self.date_from > self.date_to:
            raise InvalidRequest("the time range is inverted")

    def only_indexed(self) -> bool:
        """True if the vector index stores every column that is filtered."""
        others = [n for n in EQUALITY if n not in INDEXED and getattr(self, n)]
        return not (others or self.file_path or self.date_from or self.date_to)

    def column(self) -> Column:
        """The conjunction; TRUE without predicates. Values are literals, never SQL text."""
        self.validate()
        terms = [F.col(col) == F.lit(getattr(self, name)) for name, (col, _) in EQUALITY.items() if getattr(self, name)]
        if self.file_path:  # wildcards in the request stay wildcards
            terms.append(F.col("FilePath").like(f"%{self.file_path}%"))
        if self.date_from:
            terms.append(F.col("Timestamp") >= F.lit(self.date_from))
        if self.date_to:
            terms.append(F.col("Timestamp") <= F.lit(self.date_to))
        return reduce(lambda a, b: a & b, terms, F.lit(True))


def parse_bound(text: str, end: bool = False) -> datetime | None:
    """A bound from RFC 3339 text or a date; a date that ends a range covers its whole day."""
    if not text:
        return None
    try:
        if _DATE.fullmatch(text):
            day = datetime.fromisoformat(text).replace(tzinfo=UTC)
            return day + timedelta(days=1) - timedelta(microseconds=1) if end else day
        if found := _INSTANT.fullmatch(text):
            day, clock, fraction, zone = found.groups()
            micros = (fraction or "").ljust(6, "0")[:6]
            return datetime.fromisoformat(f"{day}T{clock}.{micros}{'+00:00' if zone == 'Z' else zone}").astimezone(UTC)
    except ValueError as error:
        raise InvalidRequest(f"bad date {text!r}") from error
    raise InvalidRequest(f"bad date {text!r}")
