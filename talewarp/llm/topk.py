"""Exact top-k search (op 10): three-phase uniform threshold (Cao and Wang, 2004).

A score is the sum over ``SLICES`` vertical slices of the vectors; each slice gives a
list of local scores. Rows lie in blocks of bounded size, one partition each, in which
they are held once; queries are sent to the blocks and stream through them a chunk at a
time. So rows are shuffled once a phase however many queries there are.

1. Gather: a query visits ``GATHER_BLOCKS`` blocks. The best entries of each of a block's
   lists send their totals. Any subset of the rows bounds the k-th best score from below,
   so the k-th best total so far is a safe cutoff t.
2. Queries carry their cutoffs to every block (by a join, as there may be many queries).
   Entries with a local score of t / SLICES or more in some list are sufficient: an
   object with none has a total below t. A list is sorted by the length of its slices,
   and |q| |x| bounds a local score, so a list is read only as far as entries can reach
   the threshold for some query of the chunk.
3. The remaining local scores of sufficient entries are resolved, where their lists
   weren't read, and totals of t or more are sent, at most k for a block and query. The k
   best by score, then id, are ranked; Spark prunes that window before its shuffle.

Among rows with equal vectors a block needs the k + 1 smallest ids only, since the rest
have the same score; so a vector that a third of all rows hold doesn't multiply entries.

Every query meets every row, so work grows with their product; the threshold cuts what
is resolved and sent.

Defined results: vectors that are null, or hold null or non-finite components, take no
part. Every other row does: of rows that repeat an id each is a candidate and, if the
id is a query's, a query, whose candidates are all rows but itself; rows without an id
are candidates, ranked after ids. Vectors of different lengths are compared as if
padded with zeros; ties go to the smaller id; queries with fewer candidates than k get
all. An empty table gives an empty result; other columns are ignored. Scores are exact
while they fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, map_batches

K, SCALE, QUERY_MODULUS, SLICES = 20, 64, 20, 2
ROW_BLOCK, LEAST_BLOCKS, GATHER_BLOCKS, STEP = 131_072, 32, 4, 64
#: Place of a missing id among ties: after all others.
_LAST = np.iinfo(np.int64).max


def quantized(vectors: DataFrame, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, q``: valid vectors as arrays of floor(scale * x)."""
    valid = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(F.col(vector_col).isNotNull()).where(F.coalesce(valid, F.lit(False)))
    return rows.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale)).alias("q"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(np.asarray(column.offsets))
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _best_first(total: np.ndarray, query: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` entries of each query, by total, then id."""
    order = np.lexsort((ids, -total, query))
    own = query[order]
    first = np.flatnonzero(np.diff(own, prepend=own[0] - 1 if len(own) else 0))
    rank = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
    return order[rank < k]


class Block:
    """The rows of one block and their local score lists."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, x: np.ndarray, slices: int, k: int):
        kept = self._distinct(ids, x, k + 1)
        self.keys, self.ids, self.x = keys[kept], ids[kept], x[kept]
        self.k, self.slices, self.part = k, slices, x.shape[1] // slices
        self.high = float(np.abs(x).max(initial=0)) * max(1, x.shape[1])
        self.lists = []
        for s in range(slices):
            own = self.x[:, s * self.part : (s + 1) * self.part]
            length = np.sqrt((own.astype(float) ** 2).sum(axis=1))
            order = np.argsort(-length, kind="stable")
            self.lists.append((order, length[order], own[order]))
        self.cast: dict[type, list[np.ndarray]] = {}

    @staticmethod
    def _distinct(ids: np.ndarray, x: np.ndarray, keep: int) -> np.ndarray:
        """Places of rows with at most the ``keep`` smallest ids of each vector."""
        factors = np.random.default_rng(1).integers(0, 1 << 63, x.shape[1], dtype=np.uint64) | np.uint64(1)
        mixed = (x.astype(np.uint64) * factors).sum(axis=1, dtype=np.uint64)
        order = np.lexsort((ids, mixed))
        first = np.flatnonzero(np.diff(mixed[order], prepend=mixed[order[0]] ^ np.uint64(1)) != 0) if len(order) else np.zeros(0, int)
        size = np.diff(np.append(first, len(order)))
        beyond = np.flatnonzero(np.arange(len(order)) - np.repeat(first, size) >= keep)
        same = (x[order[beyond]] == x[order[np.repeat(first, size)[beyond]]]).all(axis=1)
        return np.delete(order, beyond[same])

    def _list(self, s: int, y: np.ndarray, upto: int) -> np.ndarray:
        """Local scores of the first ``upto`` entries of a list, as integers in floating point where that is exact."""
        high = self.high * float(np.abs(y).max(initial=0))
        kind = np.float32 if high < 2**24 else np.float64 if high < 2**53 else np.int64
        if kind not in self.cast:
            self.cast[kind] = [own.astype(kind) for _, _, own in self.lists]
        own = y[:, s * self.part : (s + 1) * self.part]
        return own.astype(kind) @ self.cast[kind][s][:upto].T

    def _totals(self, y: np.ndarray, i: np.ndarray, j: np.ndarray, local: list[np.ndarray]) -> np.ndarray:
        """Exact totals of entries: local scores that were read are looked up, others resolved."""
        total = np.zeros(len(i), np.int64)
        for s, (one, place) in enumerate(zip(local, self._places(), strict=True)):
            at = place[j]
            read = at < one.shape[1]
            total[read] += one[i[read], at[read]].astype(np.int64)
            rest, a = np.flatnonzero(~read), slice(s * self.part, (s + 1) * self.part)
            for b in range(0, len(rest), 1 << 16):
                some = rest[b : b + (1 << 16)]
                total[some] += np.einsum("nd,nd->n", y[i[some], a], self.x[j[some], a])
        return total

    def _places(self) -> list[np.ndarray]:
        if not hasattr(self, "places"):
            self.places = [np.argsort(order, kind="stable") for order, _, _ in self.lists]
        return self.places

    def best(self, names: np.ndarray, y: np.ndarray, cutoff: np.ndarray, gather: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query (place in the chunk), row (place in the block) and total of what the chunk's queries send.

        With ``gather`` the best entries of each list, without sufficient entries.
        """
        local, found = [], []
        for s, (order, length, _) in enumerate(self.lists):
            if gather:
                one = self._list(s, y, len(order))
                number = min(gather, len(order))
                at = np.argpartition(-one, number - 1, axis=1)[:, :number] if number else np.zeros((len(y), 0), int)
                found.append((np.repeat(np.arange(len(y)), number), order[at.ravel()]))
            else:
                need = cutoff / self.slices  # -inf where there is no cutoff
                own = np.sqrt((y[:, s * self.part : (s + 1) * self.part].astype(float) ** 2).sum(axis=1))
                # the shortest entry that can reach the threshold of some query; rounding is on the safe side
                least = np.where(need <= 0, 0.0, need / np.maximum(own, 1e-300)).min(initial=np.inf) * (1 - 1e-9)
                one = self._list(s, y, int(np.searchsorted(-length, -least, side="right")))
                i, at = np.nonzero(one >= need[:, None])
                found.append((i, order[at]))
            local.append(one)
        size = max(1, len(self.ids))
        i, j = np.divmod(np.unique(np.concatenate([i * size + j for i, j in found])), size)
        total = self._totals(y, i, j, local)
        kept = (names[i] != self.keys[j]) & ~(total < cutoff[i])
        i, j, total = i[kept], j[kept], total[kept]
        first = _best_first(total, i, self.ids[j], self.k)
        return i[first], j[first], total[first]


def search(vectors: DataFrame, k: int = K, scale: int = SCALE, modulus: int = QUERY_MODULUS, slices: int = SLICES, id_col: str = "vec_id", vector_col: str = "embedding", row_block: int = ROW_BLOCK, gather_blocks: int = GATHER_BLOCKS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best rows for every query (id divisible by ``modulus``)."""
    rows = checkpointed(quantized(vectors, scale, id_col, vector_col).withColumn("key", F.monotonically_increasing_id()))
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("dim")).first()
    width = -(-max(1, size["dim"] or 1) // slices) * slices
    blocks = max(LEAST_BLOCKS, -(-size["n"] // row_block))
    few = min(gather_blocks, blocks)
    lists = -(-2 * k // few) + 1
    block = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")
    held = rows.select(block.alias("block"), F.lit(False).alias("asks"), "key", "id", "q", F.lit(None).cast("double").alias("cutoff"))
    queries = rows.where(F.col("id") % modulus == 0)

    def sent(asking: DataFrame, to: int, gather: int) -> DataFrame:
        """``query, query_id, id, total``: what queries (with ``cutoff``) get from the first ``to`` blocks, counted from their own."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ["query", "query_id", "id", "total"]
            at, parts, held = None, [], None
            for batch in batches:
                edges = [0, *(np.flatnonzero(np.diff(batch.column("block").to_numpy()) | np.diff(batch.column("asks").to_numpy(zero_copy_only=False))) + 1).tolist(), len(batch)]
                for a, b in zip(edges, edges[1:], strict=False):
                    if a == b:
                        continue
                    some = batch.slice(a, b - a)
                    if some.column("block")[0].as_py() != at:
                        at, parts, held = some.column("block")[0].as_py(), [], None
                    keys, ids = some.column("key").to_numpy(), some.column("id").fill_null(_LAST).to_numpy()
                    x = _matrix(some.column("q"), width)
                    if not some.column("asks")[0].as_py():
                        parts.append((keys, ids, x))
                        continue
                    if not parts and held is None:
                        continue  # no rows in this block
                    if held is None:
                        held, parts = Block(*(np.concatenate([p[n] for p in parts]) for n in range(3)), slices, k), []
                    cutoff = some.column("cutoff").fill_null(-np.inf).to_numpy()
                    for c in range(0, len(keys), STEP):
                        i, j, total = held.best(keys[c : c + STEP], x[c : c + STEP], cutoff[c : c + STEP], gather)
                        found = held.ids[j]
                        yield pa.RecordBatch.from_arrays([pa.array(keys[c + i]), pa.array(ids[c + i]), pa.array(found, mask=found == _LAST), pa.array(total)], names=names)

        spread = F.explode(F.sequence(F.lit(0), F.lit(to - 1)))
        placed = asking.select("key", "id", "q", "cutoff", spread.alias("step")).select(F.pmod(F.xxhash64("key") + F.col("step"), F.lit(blocks)).cast("int").alias("block"), F.lit(True).alias("asks"), "key", "id", "q", "cutoff")
        both = held.unionByName(placed).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "asks")
        return map_batches(both, run, "query long, query_id long, id long, total long")

    def first(frame: DataFrame) -> DataFrame:
        w = Window.partitionBy("query").orderBy(F.desc("total"), F.asc_nulls_last("id"))
        return frame.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    gathered = sent(queries.withColumn("cutoff", F.lit(None).cast("double")), few, lists)
    cutoffs = checkpointed(first(gathered).where(F.col("rank") == k).select(F.col("query").alias("asker"), F.col("total").cast("double").alias("cutoff")))
    ranked = first(sent(queries.join(cutoffs, queries.key == cutoffs.asker, "left"), blocks, 0))
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), F.col("total").alias("score"))


#: DuckDB: the same result by scoring every pair.
ORACLE = f"""
WITH v AS (
  SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * x::DOUBLE) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.place, a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: coalesce(z[1] * z[2], 0))) AS BIGINT) AS score
  FROM v a JOIN v b ON a.place <> b.place WHERE a.vec_id % {QUERY_MODULUS} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= {K}
"""
