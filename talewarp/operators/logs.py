"""Operators on ordered logs, as windows and ordered aggregates.

Window state is one file or conversation, the unit in which such logs are written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry(df: DataFrame | None, value: Column, partition: list[str], order: list[str], first: bool = False) -> Column:
    """The last non-null ``value`` up to a row; before any, the first in the partition if asked."""
    w = Window.partitionBy(*partition).orderBy(*order)
    last = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    if not first:
        return last
    whole = F.first(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return F.coalesce(last, whole)


def carried_timestamp(df: DataFrame, time: str, partition: list[str], order: list[str]) -> Column:
    """Missing times and times within the first second become the last valid time before, else the first valid one."""
    ts = F.col(time).cast("timestamp")
    valid = F.when(F.unix_micros(ts) >= 2_000_000, ts)
    return F.coalesce(carry(df, valid, partition, order, first=True), ts)


def repaired_timestamp(time: str, cutoff: Column, partition: list[str], order: list[str]) -> Column:
    """Missing times and times within the first second become the nearest one at or after the cutoff: before the row, else the first of its file, else the cutoff itself. Other times stay, early ones too."""
    ts = F.col(time).cast("timestamp")
    missing = ts.isNull() | (F.unix_micros(ts) < 2_000_000)
    timely = F.when(~missing & (ts >= cutoff), ts)
    return F.when(missing, F.coalesce(carry(None, timely, partition, order, first=True), cutoff)).otherwise(ts)


def paired_turns(messages: DataFrame, partition: list[str], order: list[str], role: str = "role", user: str = "user", answers: tuple[str, ...] = ("assistant",), payload: tuple[str, ...] = ("text",)) -> DataFrame:
    """Answers paired with the user message right before them among user and answer rows.

    A later user message replaces one that waits, and a pair uses it up; ``user_<column>``
    holds the user's payload and order columns.
    """
    relevant = messages.where(F.col(role).isin(user, *answers))
    w = Window.partitionBy(*partition).orderBy(*order)
    kept = [*payload, *order]
    before = F.lag(F.struct(F.col(role).alias("role"), *(F.col(c) for c in kept))).over(w)
    rows = relevant.withColumn("_before", before).where(F.col(role).isin(*answers) & (F.col("_before.role") == user))
    return rows.select(*messages.columns, *(F.col(f"_before.{c}").alias(f"user_{c}") for c in kept))


def turn_groups(messages: DataFrame, partition: list[str], order: list[str], is_user: Column) -> DataFrame:
    """``turn_group``: the number of user messages up to a row; 0 before the first."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return messages.withColumn("turn_group", F.sum(F.when(is_user, 1).otherwise(0)).over(w))


def joined_in_order(order: list[str], text: Column, separator: str = "\n") -> Column:
    """Aggregate: texts of a group, joined in order; nulls are left out."""
    items = F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct(*(F.col(c) for c in order), text.alias("_text")))))
    return F.array_join(F.transform(items, lambda x: x["_text"]), separator)


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the last in order. An arg-max that combines before the shuffle."""
    others = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*(F.col(c) for c in others)), F.struct(*(F.col(c) for c in order)))
    return rows.groupBy(*keys).agg(best.alias("_row")).select(*(F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in rows.columns))


def with_children(parents: DataFrame, children: DataFrame, parent_key: str = "Id", child_parent: str = "ParentChunkId", order: str = "SourceLine") -> DataFrame:
    """``ChildChunkIds``: for each parent the ids of its children in order."""
    ids = children.where(F.col(child_parent).isNotNull()).groupBy(child_parent).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col("Id")))), lambda x: x["Id"]).alias("ChildChunkIds"))
    return parents.drop("ChildChunkIds").join(ids.withColumnRenamed(child_parent, parent_key), parent_key, "left")


def eligibility(rows: DataFrame, path: str, time: str, cutoff: Column, meaningful: Column, issue: Column) -> DataFrame:
    """``status`` of each file: refuse (a time before the cutoff, or a meaningful row without one), wait (an issue, or no time), accept."""
    ts = F.col(time).cast("timestamp")
    grouped = rows.groupBy(path).agg(
        F.min(ts).alias("first_time"),
        F.count_if(ts < cutoff).alias("early"),
        F.count_if(meaningful & ts.isNull()).alias("untimed"),
        F.count_if(issue).alias("issues"),
    )
    status = F.when((F.col("early") > 0) | (F.col("untimed") > 0), "refuse").when((F.col("issues") > 0) | F.col("first_time").isNull(), "wait").otherwise("accept")
    return grouped.withColumn("status", status)


def debounced(events: DataFrame, path: str, time: str, now: Column, delay_seconds: float) -> DataFrame:
    """``path, time`` of the last event of each path that has been quiet for the delay, by path."""
    last = events.groupBy(path).agg(F.max(F.col(time).cast("timestamp")).alias(time))
    return last.where(F.col(time) + F.expr(f"INTERVAL '{delay_seconds}' SECOND") <= now).orderBy(path)
