"""A two-level vector index: branches, leaves within them, and residuals as product codes.

Branches and leaves are centroids of unit vectors (k-means on a bounded sample by id
hash). A row's residual, its unit vector less its leaf's centroid, is cut into
``subspaces``, and each part is named by the nearest of ``codewords`` (Jégou, Douze and
Schmid, 2011). A search visits the leaves nearest to the query, ranks their rows by codes
alone, of one byte a subspace, and then reads the vectors of the best ``rerank`` times k
rows and ranks these exactly.

Training is spread over tasks: branches by Spark's k-means, the leaves of a branch and the
codewords of a subspace each in a task of their own over the bounded sample. The model has
as many numbers as its parameters say, whatever the table's size.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .vector import STORED, cosine_distance, train_leaves, unit

SAMPLE_ROWS = 100_000
#: Parts of a residual and names for each, and rows that are ranked exactly for each wanted one.
SUBSPACES, CODEWORDS, RERANK = 16, 64, 20
#: Share of all leaves that a search visits.
VISITED = 0.65


def kmeans(x: np.ndarray, k: int, seed: int = 7, rounds: int = 10) -> np.ndarray:
    """At most ``k`` centroids of the rows of ``x``."""
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    centres = distinct[np.random.default_rng(seed).choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        near = nearest(x, centres)
        number = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(number[:, None] > 0, sums / np.maximum(number, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T - 0.5 * (centres**2).sum(axis=1)).argmax(axis=1)


class Tree:
    """``branches`` (b, d); ``leaves`` (l, d) with the branch of each; ``codes`` (subspaces, codewords, width)."""

    def __init__(self, branches: np.ndarray, leaves: np.ndarray, branch_of: np.ndarray, codes: np.ndarray):
        self.branches, self.leaves, self.branch_of, self.codes = branches, leaves, branch_of, codes

    def __len__(self) -> int:
        return len(self.leaves)

    def assign(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf and codes of unit vectors."""
        branch, leaf = nearest(units, self.branches), np.zeros(len(units), np.int64)
        for b in np.unique(branch):
            own, rows = np.flatnonzero(self.branch_of == b), branch == b
            leaf[rows] = own[nearest(units[rows], self.leaves[own])]
        rest = padded(units - self.leaves[leaf], self.codes)
        return leaf, np.stack([nearest(rest[:, m], self.codes[m]) for m in range(len(self.codes))], axis=1).astype(np.uint8)

    def visit(self, query: np.ndarray, share: float) -> list[int]:
        """The leaves nearest to a unit query, in the nearest branches first where two are alike."""
        score = self.leaves @ query - 0.5 * (self.leaves**2).sum(axis=1)
        return np.argsort(-score, kind="stable")[: max(1, math.ceil(share * len(self)))].tolist()

    def save(self, spark: SparkSession, folder: str) -> None:
        parts = {"branches": self.branches, "leaves": self.leaves, "branch_of": self.branch_of[:, None], "codes": self.codes.reshape(-1, self.codes.shape[-1])}
        rows = [(name, i, [float(v) for v in row]) for name, table in parts.items() for i, row in enumerate(table)]
        spark.createDataFrame([*rows, ("shape", 0, [float(v) for v in self.codes.shape])], "part string, number int, row array<double>").coalesce(1).write.parquet(folder)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Tree:
        found = spark.read.parquet(folder).orderBy("part", "number").toPandas().groupby("part")["row"]
        parts = {name: np.stack(list(rows)) for name, rows in found}
        return cls(parts["branches"], parts["leaves"], parts["branch_of"][:, 0].astype(int), parts["codes"].reshape([int(v) for v in parts["shape"][0]]))


def padded(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Rows cut into subspaces, with zeros after the last number."""
    m, _, width = codes.shape
    return np.pad(x, ((0, 0), (0, m * width - x.shape[1]))).reshape(len(x), m, width)


def train(chunks: DataFrame, leaves: int, subspaces: int = SUBSPACES, codewords: int = CODEWORDS, sample_rows: int = SAMPLE_ROWS, seed: int = 7, id_col: str = "Id", vector: str = "Vector") -> Tree:
    """A tree of about ``leaves`` leaves; ``codewords`` is 256 at most."""
    model = train_leaves(chunks, max(2, round(math.sqrt(leaves))), seed, sample_rows, id_col, vector)
    branches = np.array(model.clusterCenters())
    rows = chunks.where(F.col(vector).isNotNull())
    # hashes of 63 bits, so that the share is above zero however large the table
    limit = min((1 << 63) - 1, max(1, ((1 << 63) - 1) * sample_rows // max(1, rows.count())))
    sample = rows.where(F.shiftrightunsigned(F.xxhash64(id_col), 1) <= F.lit(limit)).select(unit(vector).alias("unit"))
    each = max(1, round(leaves / len(branches)))
    width = math.ceil(branches.shape[1] / subspaces)

    def branch_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield pd.DataFrame({"branch": nearest(np.stack(list(frame["unit"])), branches), "unit": frame["unit"]})

    def leaves_of(key: tuple[int], frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"branch": key[0], "row": list(kmeans(np.stack(list(frame["unit"])), each, seed))})

    dealt = sample.mapInPandas(branch_of, "branch int, unit array<double>")
    found = dealt.groupBy("branch").applyInPandas(leaves_of, "branch int, row array<double>").toPandas().sort_values("branch", kind="stable")
    tree = Tree(branches, np.stack(list(found["row"])), found["branch"].to_numpy(), np.zeros((subspaces, 1, width)))

    def residuals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            x = np.stack(list(frame["unit"]))
            parts = padded(x - tree.leaves[tree.assign(x)[0]], tree.codes)
            for m in range(subspaces):
                yield pd.DataFrame({"m": m, "part": list(parts[:, m])})

    def words_of(key: tuple[int], frame: pd.DataFrame) -> pd.DataFrame:
        centres = kmeans(np.stack(list(frame["part"])), codewords, seed)
        # where there are fewer parts than names, the first is repeated
        return pd.DataFrame({"m": key[0], "row": list(centres[np.arange(codewords) % len(centres)])})

    words = sample.mapInPandas(residuals, "m int, part array<double>").groupBy("m").applyInPandas(words_of, "m int, row array<double>").toPandas().sort_values("m", kind="stable")
    return Tree(tree.branches, tree.leaves, tree.branch_of, np.stack(list(words["row"])).reshape(subspaces, codewords, width))


def assigned(chunks: DataFrame, tree: Tree, stored: Sequence[str] = tuple(STORED), vector: str = "Vector") -> DataFrame:
    """Every row that has a vector: ``stored``, the vector, its leaf and its codes."""
    rows = chunks.where(F.col(vector).isNotNull()).select(*stored, vector)
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(vector).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(float)
            leaf, codes = shared.value.assign(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300))
            added = [pa.array(leaf, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "leaf", "code"])

    return rows.mapInArrow(run, f"{rows.schema.toDDL()}, leaf int, code binary")


def candidates(index: DataFrame, tree: Tree, query: Sequence[float], rows: int, share: float = VISITED, where: Column | None = None, id_col: str = "Id") -> DataFrame:
    """Ids of the ``rows`` best by their codes among the visited leaves. No vector is read."""
    q = np.array(query, float)
    q /= np.linalg.norm(q) or 1.0
    near = tree.visit(q, share)
    weights = np.einsum("mkw,mw->mk", tree.codes, padded(q[None], tree.codes)[0])
    words = tree.codes.shape[1]
    table = F.from_json(F.lit(json.dumps(weights.ravel().tolist())), "array<double>")
    base = F.element_at(F.from_json(F.lit(json.dumps((tree.leaves @ q).tolist())), "array<double>"), F.col("leaf") + 1)
    places = F.sequence(F.lit(0), F.lit(len(tree.codes) - 1))
    name = lambda m: F.conv(F.hex(F.substring(F.col("code"), m + 1, F.lit(1))), 16, 10).cast("int")
    score = F.aggregate(places, base, lambda s, m: s + F.get(table, m * words + name(m)))
    found = index.where(F.col("leaf").isin(near))
    found = found if where is None else found.where(where)
    return found.select(id_col, score.alias("_score")).orderBy(F.desc("_score"), id_col).limit(rows).select(id_col)


def topk(index: DataFrame, tree: Tree, query: Sequence[float], k: int, share: float = VISITED, where: Column | None = None, rerank: int = RERANK, vector: str = "Vector", id_col: str = "Id") -> DataFrame:
    """The ``k`` nearest of the candidates, with their exact ``Distance``; ties by id."""
    best = candidates(index, tree, query, k * rerank, share, where, id_col)
    # k times ``rerank`` rows
    rows = index.join(F.broadcast(best), id_col, "left_semi")
    return rows.withColumn("Distance", cosine_distance(vector, query)).orderBy("Distance", id_col).limit(k)
