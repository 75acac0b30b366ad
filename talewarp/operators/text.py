"""Full-text search: an inverted index and BM25, as joins and aggregates.

A token is a maximal run of letters and digits, lower-cased. A query matches documents
that hold all of its distinct tokens. Scores are Okapi BM25 (Robertson and Zaragoza,
2009), with document frequencies over the whole indexed table.

A stored index has its postings in blocks of documents of like length (after block-max
indexes, Ding and Suel, 2011). A block's head tells the largest frequency and the largest
density (frequency by length) of its token there, which bound every score in the block
whatever the table's average length has become. A search reads the heads of its tokens,
scores the blocks of the greatest bounds, and then reads only blocks that can beat the
k-th score found. Least densities that follow from it are filters on a column by which
the files are sorted, so that Parquet passes over pages of postings.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: Documents of a block, and blocks that are scored first.
BLOCK, SEEDS = 16, 64
#: Tokens of a bucket whose postings are made and sorted by one task in memory.
BUCKET_TOKENS = 2_000_000
#: Keys of blocks that are broadcast at most (about 100 bytes each).
FEW_BLOCKS = 200_000
SPLIT = r"[^\p{L}\p{N}]+"


def tokens(text: str | Column) -> Column:
    """All tokens of a text, in order."""
    col = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(F.coalesce(col, F.lit(""))), SPLIT), lambda t: t != "")


def query_tokens(text: str) -> list[str]:
    return sorted({t for t in re.split(r"[\W_]+", text.lower()) if t})


def _equal_to(word: str):
    return lambda token: token == word


def inverted_index(docs: DataFrame, id_col: str = "Id", text_col: str = "Content", keep: tuple[str, ...] = ()) -> DataFrame:
    """``token, Id, tf, dl`` of every document, and its columns ``keep``."""
    split = docs.select(F.col(id_col).alias("Id"), *keep, tokens(text_col).alias("t")).select("Id", *keep, F.size("t").alias("dl"), F.explode("t").alias("token"))
    return split.groupBy("token", "Id", "dl", *keep).agg(F.count("*").alias("tf"))


def bm25_topk(docs: DataFrame, query: str, k: int, where: Column | None = None, id_col: str = "Id", text_col: str = "Content", k1: float = K1, b: float = B) -> DataFrame:
    """``Id, Score, Distance`` of the ``k`` best documents; Distance is 1 - Score.

    Without a stored index the texts are read twice: for the corpus's numbers, and for
    the documents that hold the query's words, of which those whose text lacks one are
    left out before they are split. Only the query's tokens are counted, and each text
    is split once a pass.
    """
    wanted = query_tokens(query)
    if not wanted:
        return docs.select(F.col(id_col).alias("Id"), F.lit(0.0).alias("Score"), F.lit(0.0).alias("Distance")).limit(0)

    def counted(rows: DataFrame) -> DataFrame:
        # within the lambda the tokens are a variable, so they aren't computed for each count
        numbers = F.transform(F.array(tokens(text_col)), lambda t: F.struct(F.size(t).alias("dl"), *(F.size(F.filter(t, _equal_to(w))).alias(f"tf{i}") for i, w in enumerate(wanted))))
        return rows.select(F.col(id_col).alias("Id"), F.explode(numbers).alias("_c")).select("Id", "_c.*")

    corpus = counted(docs).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))))
    lower = F.lower(F.col(text_col))
    holding = docs if where is None else docs.where(where)
    for w in wanted:
        holding = holding.where(F.contains(lower, F.lit(w)))
    matched = counted(holding).where(F.least(*(F.col(f"tf{i}") for i in range(len(wanted))), F.lit(1 << 30)) > 0)

    def part(i: int) -> Column:
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))

    scored = matched.join(F.broadcast(corpus)).select("Id", sum((part(i) for i in range(len(wanted))), F.lit(0.0)).alias("Score"))
    return scored.withColumn("Distance", 1 - F.col("Score")).orderBy(F.desc("Score"), "Id").limit(k)


def search_index(index: DataFrame, stats: DataFrame, query: str, k: int, allowed: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """As ``bm25_topk``, from a stored inverted index and its ``n, avgdl`` row; ``allowed`` has the ids that a filter leaves."""
    wanted = query_tokens(query)
    hits = index.where(F.col("token").isin(wanted))
    df = hits.groupBy("token").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    # one row for each token of the query, and one row
    scored = hits.join(F.broadcast(df), "token").join(F.broadcast(stats)).groupBy("Id").agg(F.sum(weight).alias("Score"), F.count("*").alias("hit")).where(F.col("hit") == len(wanted))
    if allowed is not None:
        scored = scored.join(allowed, "Id", "left_semi")
    return scored.select("Id", "Score", (1 - F.col("Score")).alias("Distance")).orderBy(F.desc("Score"), "Id").limit(k)


def numbered(docs: DataFrame, text_col: str = "Content", id_col: str = "Id", bucket: str = "bucket") -> DataFrame:
    """``docs`` with ``dl``, the number of tokens, and ``block``: documents of like length share a block of their bucket."""
    by_length = Window.partitionBy(bucket).orderBy("dl", id_col)
    rows = docs.withColumn("dl", F.size(tokens(text_col)))
    return rows.withColumn("block", F.floor((F.row_number().over(by_length) - 1) / BLOCK).cast("int"))


def posting_blocks(docs: DataFrame, text_col: str = "Content", id_col: str = "Id") -> DataFrame:
    """``token, bucket, block, n, most, density, posts`` of numbered documents, a row for each token of a block.

    Where all documents of a block are in one task already, nothing is shuffled.
    """
    split = docs.select("bucket", "block", F.col(id_col).alias("Id"), "dl", F.explode(tokens(text_col)).alias("token"))
    postings = split.groupBy("token", "bucket", "block", "Id", "dl").agg(F.count("*").alias("tf"))
    posts = F.array_sort(F.collect_list(F.struct("Id", "tf", "dl")))
    return postings.groupBy("token", "bucket", "block").agg(F.count("*").alias("n"), F.max("tf").alias("most"), F.max(F.col("tf") / F.col("dl")).alias("density"), posts.alias("posts"))


class BlockSearch:
    """A query over posting blocks: its numbers, the blocks that it must read, and its best documents.

    ``index`` has rows of ``posting_blocks``, where ``keys`` tell blocks apart; ``stats``
    has one row ``n, avgdl``; ``allowed`` has the ids that a filter leaves.
    """

    def __init__(self, index: DataFrame, stats: DataFrame, query: str, k: int, allowed: DataFrame | None = None, keys: tuple[str, ...] = ("bucket", "block"), seeds: int = SEEDS, k1: float = K1, b: float = B):
        self.wanted, self.k, self.allowed, self.keys, self.k1, self.b = query_tokens(query), k, allowed, list(keys), k1, b
        self.index = index.where(F.col("token").isin(self.wanted))
        heads = self.index.select("token", *keys, "n", "most", "density")
        # one row for each token of the query
        found = {r["token"]: r for r in heads.groupBy("token").agg(F.sum("n").alias("df"), F.max("most").alias("most"), F.max("density").alias("density")).collect()}
        row = stats.first()
        self.n, self.avgdl = row["n"] or 0, row["avgdl"] or 0.0
        self.empty = not self.wanted or len(found) < len(self.wanted)
        self.idf = {t: math.log(1 + (self.n - r["df"] + 0.5) / (r["df"] + 0.5)) for t, r in found.items()}
        self.best = {t: self.idf[t] * self._bound(r["most"], r["density"]) for t, r in found.items()}
        if not self.empty:
            bound = self._idf() * self._bound(F.col("most"), F.col("density"))
            self.bounds = heads.groupBy(*keys).agg(F.sum(bound).alias("bound"), F.count("*").alias("hit")).where(F.col("hit") == len(self.wanted)).drop("hit")
            first = self.bounds.orderBy(F.desc("bound"), *keys).limit(seeds)
            top = self._scored(self.index.join(F.broadcast(first.select(*keys)), self.keys, "left_semi")).collect()
            #: the k-th score of the first blocks, a little less for the order of sums
            self.floor = top[-1]["Score"] * (1 - 1e-9) if len(top) == k else 0.0

    def _bound(self, most, density):
        """No posting of a block weighs more, with the idf left out."""
        return (self.k1 + 1) / (1 + self.k1 * (1 - self.b) / most + self.k1 * self.b / self.avgdl / density)

    def _idf(self) -> Column:
        return F.element_at(F.create_map(*(F.lit(x) for pair in self.idf.items() for x in pair)), F.col("token"))

    def _scored(self, blocks: DataFrame) -> DataFrame:
        """``Id, Score, Distance`` of the best documents of some blocks."""
        tf, k1, b = F.col("p.tf"), self.k1, self.b
        weight = self._idf() * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("p.dl") / F.lit(self.avgdl)))
        rows = blocks.select("token", F.explode("posts").alias("p")).groupBy(F.col("p.Id").alias("Id")).agg(F.sum(weight).alias("Score"), F.count("*").alias("hit"))
        rows = rows.where(F.col("hit") == len(self.wanted))
        if self.allowed is not None:
            rows = rows.join(self.allowed, "Id", "left_semi")
        return rows.select("Id", "Score", (1 - F.col("Score")).alias("Distance")).orderBy(F.desc("Score"), "Id").limit(self.k)

    def least_density(self, token: str) -> float:
        """Blocks in which the token is less dense can't reach the floor, whatever the other tokens weigh."""
        need = (self.floor - sum(v for t, v in self.best.items() if t != token)) / self.idf[token]
        if need <= 0:
            return 0.0
        rest = (self.k1 + 1) / need - 1
        return self.k1 * self.b / self.avgdl / rest * (1 - 1e-9) if rest > 0 else math.inf

    def blocks(self) -> DataFrame:
        """The rows of the index that are read: blocks whose bounds reach the floor."""
        dense = reduce(or_, ((F.col("token") == t) & (F.col("density") >= self.least_density(t)) for t in self.wanted))
        reach = self.bounds.where(F.col("bound") >= self.floor).select(*self.keys)
        if reach.limit(FEW_BLOCKS + 1).count() <= FEW_BLOCKS:
            reach = F.broadcast(reach)
        return self.index.where(dense).join(reach, self.keys, "left_semi")

    def top(self) -> DataFrame:
        """``Id, Score, Distance`` of the ``k`` best documents, as ``bm25_topk``."""
        if self.empty:
            return self.index.sparkSession.createDataFrame([], "Id string, Score double, Distance double")
        return self._scored(self.blocks())
