"""Routing of files to readers, and the union of all readers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.files import source_kind
from . import antigravity, claude, codex, exports, gemini

READERS = {
    "claude": claude.chunks,
    "codex": codex.chunks,
    "gemini": gemini.chunks,
    "chatgpt": exports.chatgpt_chunks,
    "claudeapp": exports.claudeapp_chunks,
}


def routed(files: DataFrame) -> DataFrame:
    """``files`` with their ``kind``; files that no reader takes are left out."""
    return files.withColumn("kind", source_kind(F.col("path"))).where("kind IS NOT NULL")


def all_chunks(files: DataFrame, machine: str = "", sessions: DataFrame | None = None, only: set[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Chunks and issues of all files (``path, content``); ``only`` names the kinds that are there."""
    kinds = routed(files)
    outs = [reader(kinds.where(F.col("kind") == kind), machine) for kind, reader in READERS.items() if only is None or kind in only]
    if only is None or "antigravity" in only:
        binary = F.lower("path").endswith(".pb")
        steps = kinds.where(F.col("kind") == "antigravity")
        chunks, issues = antigravity.chunks(steps.where(~binary), machine, sessions)
        outs.append((chunks.unionByName(antigravity.binary_chunks(steps.where(binary), machine)), issues))
    chunks, issues = outs[0]
    for more, wrong in outs[1:]:
        chunks, issues = chunks.unionByName(more), issues.unionByName(wrong)
    return chunks, issues
