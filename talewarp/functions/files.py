"""File operations in shell commands and patches, and routing of paths to sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATION = "struct<path:string,kind:string,summary:string>"

#: Shell rules in order of priority; the first that matches gives the operation.
SHELL_RULES = [
    (r"\brm[\t\n\f\r ]+(?:-[^\t\n\f\r ]+[\t\n\f\r ]+)?([^\t\n\f\r ]+)", "delete", "Deleted file"),
    (r"\bmv[\t\n\f\r ]+[^\t\n\f\r ]+[\t\n\f\r ]+([^\t\n\f\r ]+)", "move", "Moved file"),
    (r"\bcp[\t\n\f\r ]+[^\t\n\f\r ]+[\t\n\f\r ]+([^\t\n\f\r ]+)", "write", "Copied file"),
    (r"\btouch[\t\n\f\r ]+([^\t\n\f\r ]+)", "write", "Touched file"),
    (r"\bmkdir[\t\n\f\r ]+(?:-p[\t\n\f\r ]+)?([^\t\n\f\r ]+)", "write", "Created directory"),
    (r">[\t\n\f\r ]*([^\t\n\f\r ]+)", "write", "Wrote file"),
    (r"\btee[\t\n\f\r ]+(?:-a[\t\n\f\r ]+)?([^\t\n\f\r ]+)", "write", "Wrote file"),
    (r"(?d)\bsed[\t\n\f\r ]+-i.*[\t\n\f\r ]+([^\t\n\f\r ]+)\z", "edit", "Edited file"),
]
#: Header lines of a patch.
PATCH_HEADERS = [
    ("*** Add File: ", "write", "Added file"),
    ("*** Update File: ", "edit", "Updated file"),
    ("*** Delete File: ", "delete", "Deleted file"),
    ("*** Move to: ", "move", "Moved file"),
]


def _operation(path: Column, kind: str, summary: str) -> Column:
    return F.struct(path.alias("path"), F.lit(kind).alias("kind"), F.lit(summary).alias("summary"))


def shell_operations(command: Column) -> Column:
    """At most one operation of a shell command, as an array."""

    def first_rule(text: Column) -> Column:
        return F.coalesce(*(F.when(text.rlike(p), _operation(F.regexp_extract(text, p, 1), kind, summary)) for p, kind, summary in SHELL_RULES))

    return F.array_compact(F.transform(F.array(command), first_rule))


def patch_operations(patch: Column, headers: list[tuple[str, str, str]] = PATCH_HEADERS) -> Column:
    """The operations that a patch's header lines name, in order.

    Only lines that begin with a header count.
    """

    def line_operation(line: Column) -> Column:
        out = F.lit(None).cast(OPERATION)
        for prefix, kind, summary in reversed(headers):
            path = F.trim(F.substring(line, F.lit(len(prefix) + 1), F.length(line)))
            out = F.when(line.startswith(prefix) & (path != ""), _operation(path, kind, summary)).otherwise(out)
        return out

    return F.array_compact(F.transform(F.split(F.coalesce(patch, F.lit("")), "\n"), line_operation))


def source_kind(path: Column) -> Column:
    """The source that reads a file, by the first rule that holds; null if none does."""
    base = F.element_at(F.split(path, "/"), -1)
    lower, low_base = F.lower(path), F.lower(base)
    chats = lower.contains("/chats/")
    session = low_base.startswith("session-") & low_base.endswith(".json")
    return (
        F.when((base == "conversations.json") & lower.contains("claude-app"), "claudeapp")
        .when(base == "conversations.json", "chatgpt")
        .when(lower.contains("/.gemini/antigravity/") | lower.contains("/antigravity/user/"), F.when(base == "transcript_full.jsonl", "antigravity"))
        .when((base == "transcript_full.jsonl") | low_base.endswith(".pb"), "antigravity")
        .when(lower.contains("/.gemini/tmp/"), F.when((base == "logs.json") | (chats & session), "gemini"))
        .when((base == "logs.json") | (chats & low_base.endswith(".json")), "gemini")
        .when(low_base.endswith(".jsonl") & (lower.contains("codex") | lower.contains("/archived_sessions/") | low_base.startswith("rollout-")), "codex")
        .when(low_base.endswith(".jsonl"), "claude")
    )
