"""Latest row per session, and corpus statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_per_session(rows: DataFrame, k: int, where: Column | None = None, session: str = "SessionId", time: str = "Timestamp", id_col: str = "Id") -> DataFrame:
    """The most recent row (ties: smaller id) of each of the ``k`` most recent sessions.

    An arg-max aggregate, which combines before the shuffle however large a session is;
    only the ids of the short result are joined back to the wide rows.
    """
    kept = rows if where is None else rows.where(where)
    # as min over (-time, id): the latest time, then the smallest id
    key = F.struct((-F.unix_micros(F.col(time).cast("timestamp"))).alias("before"), F.col(id_col).alias("best"))
    latest = kept.groupBy(session).agg(F.min(key).alias("key")).select(F.col("key.best").alias(id_col), "key.before")
    top = latest.orderBy("before", id_col).limit(k)
    return rows.join(F.broadcast(top), id_col).orderBy("before", id_col).drop("before").withColumn("Distance", F.lit(0.0))


def store_stats(rows: DataFrame, vector: str = "Vector") -> DataFrame:
    """One row: ``total, embedded, awaiting``."""
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col(vector).isNotNull()).alias("embedded")).withColumn("awaiting", F.col("total") - F.col("embedded"))


def progress(before: tuple[int, float] | None, embedded: int, awaiting: int, now: float) -> dict[str, float | None]:
    """Rows a minute since the sample before (embedded, seconds), and the seconds that remain."""
    rate = None
    if before and now > before[1] and embedded >= before[0]:
        rate = (embedded - before[0]) * 60 / (now - before[1])
    return {"rate_per_minute": rate, "eta_seconds": awaiting * 60 / rate if rate else None}


def exists(rows: DataFrame, value: str | int, id_col: str = "Id") -> bool:
    return bool(rows.where(F.col(id_col) == value).limit(1).count())
