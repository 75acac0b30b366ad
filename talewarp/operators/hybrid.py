"""Hybrid search: reciprocal rank fusion (Cormack et al., 2009) of two ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K, CANDIDATES = 60, 100


def ranked(top: DataFrame, *order) -> DataFrame:
    """``Id, rank``: the 0-based place of each row of a list that is already cut to a top-n.

    The window has no partitions, which is right for a list bounded by the request's
    candidate limit.
    """
    return top.select("Id", (F.row_number().over(Window.orderBy(*order)) - 1).alias("rank"))


def fuse(lists: list[DataFrame], k: int, rrf_k: int = RRF_K) -> DataFrame:
    """``Id, Score, Distance`` of the ``k`` best fused ids.

    Score is the sum of 1 / (rrf_k + rank + 1) over the lists; Distance is one minus
    its share of the best possible score, at least 0.
    """
    both = lists[0]
    for other in lists[1:]:
        both = both.unionByName(other)
    fused = both.groupBy("Id").agg(F.sum(F.lit(1.0) / (F.lit(float(rrf_k)) + F.col("rank") + F.lit(1.0))).alias("Score"))
    best = F.lit(float(len(lists))) / F.lit(float(rrf_k + 1))
    return fused.withColumn("Distance", F.lit(1.0) - F.least(F.lit(1.0), F.col("Score") / best)).orderBy(F.desc("Score"), "Id").limit(k)


def late_materialized(top: DataFrame, chunks: DataFrame, columns: list[str], id_col: str = "Id") -> DataFrame:
    """Wide columns for a short list of ids. The list is bounded by a request's limit, so it is broadcast."""
    return chunks.select(id_col, *(c for c in columns if c != id_col)).join(F.broadcast(top), id_col)
