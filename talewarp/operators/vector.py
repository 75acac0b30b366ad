"""Vector search: exact top-k, and an inverted-file index for approximate top-k."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that an index row carries beside its vector.
STORED = ["Id", "ChunkType", "SessionId", "ProjectName", "MachineId"]
BUILD_THRESHOLD = 10_000
#: Leaves and probes for tables of some thousand rows; tests hold recall at 0.9 or more.
SMALL_LEAVES, SMALL_PROBES = 16, 11


def probes_for(leaves: int) -> int:
    """Leaves that a query visits: as many as give a recall of 0.9 on vectors without clusters."""
    return max(1, -(-leaves * 30 // 100))


def cosine_distance(vector: str | Column, query: Sequence[float]) -> Column:
    """1 - cosine similarity in double precision, as built-in higher-order functions."""
    v = F.col(vector) if isinstance(vector, str) else vector
    q = F.array(*(F.lit(float(x)) for x in query))
    zero = F.lit(0.0)
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a.cast("double") * b), zero, lambda s, x: s + x)
    norm = F.aggregate(v, zero, lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.lit(1.0) - dot / (F.sqrt(norm) * F.lit(math.sqrt(sum(float(x) ** 2 for x in query))))


def exact_topk(chunks: DataFrame, query: Sequence[float], k: int, where: Column | None = None, vector: str = "Vector", id_col: str = "Id") -> DataFrame:
    """The ``k`` nearest rows with ``Distance``, ties by id. Filters come before the top-k."""
    rows = chunks.where(F.col(vector).isNotNull())
    if where is not None:
        rows = rows.where(where)
    return rows.withColumn("Distance", cosine_distance(vector, query)).orderBy("Distance", id_col).limit(k)


def unit(vector: str | Column) -> Column:
    """The vector divided by its norm."""
    v = F.col(vector) if isinstance(vector, str) else vector
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / norm)


def train_leaves(chunks: DataFrame, leaves: int, seed: int = 7, sample_rows: int = 200_000, id_col: str = "Id", vector: str = "Vector"):
    """A k-means model of unit vectors, from a sample by id hash that has about ``sample_rows`` rows at most."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = chunks.where(F.col(vector).isNotNull())
    total = rows.count()
    # hashes of 63 bits, so that the share is above zero however large the table
    limit = max(1, int(min(1.0, sample_rows / max(1, total)) * ((1 << 63) - 1)))
    sample = rows if total <= sample_rows else rows.where(F.shiftrightunsigned(F.xxhash64(id_col), 1) <= F.lit(limit))
    units = sample.select(array_to_vector(unit(vector)).alias("unit"))
    return KMeans(k=max(2, min(leaves, total)), seed=seed, featuresCol="unit", predictionCol="leaf", maxIter=10).fit(units)


def assigned(chunks: DataFrame, model, stored: Sequence[str] = tuple(STORED), vector: str = "Vector") -> DataFrame:
    """Every row that has a vector, with its nearest centroid as ``leaf``."""
    from pyspark.ml.functions import array_to_vector

    rows = chunks.where(F.col(vector).isNotNull())
    return model.transform(rows.select(*stored, vector, array_to_vector(unit(vector)).alias("unit"))).drop("unit")


def centres_of(model) -> list[list[float]]:
    return [list(map(float, c)) for c in model.clusterCenters()]


def build_index(chunks: DataFrame, leaves: int, seed: int = 7, sample_rows: int = 200_000, stored: Sequence[str] = tuple(STORED), vector: str = "Vector") -> tuple[DataFrame, list[list[float]]]:
    """Rows with their leaf, and the centroids. Centroids come from a bounded sample; every row is assigned."""
    model = train_leaves(chunks, leaves, seed, sample_rows, stored[0], vector)
    return assigned(chunks, model, stored, vector), centres_of(model)


def nearest_leaves(centres: Sequence[Sequence[float]], query: Sequence[float], probes: int) -> list[int]:
    """The centroids nearest to the query's direction; a loop over the centroids, which are few."""
    norm = math.sqrt(sum(x * x for x in query)) or 1.0
    away = [(sum((c - q / norm) ** 2 for c, q in zip(centre, query, strict=True)), leaf) for leaf, centre in enumerate(centres)]
    return [leaf for _, leaf in sorted(away)[:probes]]


def ann_topk(index: DataFrame, centres: Sequence[Sequence[float]], query: Sequence[float], k: int, probes: int, where: Column | None = None, vector: str = "Vector", id_col: str = "Id") -> DataFrame:
    """Top-k among the rows of the ``probes`` nearest leaves."""
    near = index.where(F.col("leaf").isin(nearest_leaves(centres, query, probes)))
    return exact_topk(near, query, k, where, vector, id_col)


def all_of(terms: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, terms, F.lit(True))
