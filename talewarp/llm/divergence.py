"""Source divergence audit (op 11): three-dimensional cube partitioning.

Groups are the sources of a language, and the language as a whole. A term is a run of
ASCII letters and characters beyond ASCII, with A-Z lower-cased; a language keeps the
``V`` terms that occur in at least ``MIN_DOCS`` of its documents. A group gives a kept
term that it has ``count`` times of ``N`` the smoothed share
``p = 1 + floor(10^9 (count + 1) / (N + V))``, and two groups differ in a term by
``floor((p - q)^2 / q)``. All arithmetic is on integers.

Comparing every source with every other one, term by term, is a cube. Its cells are
(group block, group block, term block): a slice of counts (group block, term block) is
replicated to the cells of all blocks that its own is compared with, a cell adds up its
terms for its pairs in both directions, and the cells' partial sums are reduced along the
term axis. A cell holds at most two blocks of about ``GROUPS`` groups by about ``TERMS``
terms, however large the input is. Terms that neither side of a cell has are counted, not
stored.

Counts are summed by each task, before they are shuffled by (language, source, term), so a
source, a language or a term with a third of all rows is spread over tasks. Tables of
groups are broadcast while they have at most ``FEW_ROWS`` rows.

Defined results: null text, language and source count as empty; a group without terms has
p = 1 + floor(10^9 / V) for every kept term; a language without kept terms has pairs of
value 0 and no terms; a source that is alone in its language has no pairs; repeated rows
count as rows; an empty table gives an empty result; other columns are ignored. Counts of
a language may have up to 9 * 10^15 terms in all.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, by_bytes, checkpointed, map_batches, quoted, small_or_not, written

#: Documents of a language that must hold a term, and ranks of the terms that are reported.
MIN_DOCS, TOP_TERMS = 3, 200
#: Groups and terms of a block, on average.
GROUPS, TERMS = 16, 4096
SCALE = 1_000_000_000
SLICE_BYTES = 4 << 20
#: Terms whose counts a task holds before it hands them on.
HELD_TERMS = 1 << 19
#: Groups that are broadcast at most (about 100 bytes each).
FEW_ROWS = 200_000

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


class _Held:
    """Counts of a task's texts so far."""

    def __init__(self):
        self.groups, self.numbers = defaultdict(count().__next__), defaultdict(count().__next__)
        self.keys, self.n, self.docs = [], [], []

    @property
    def full(self) -> bool:
        return len(self.numbers) >= HELD_TERMS or sum(map(len, self.keys)) >= 8 * HELD_TERMS

    def add(self, part: pa.RecordBatch) -> None:
        of_doc = np.array([self.groups[x] for x in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), strict=True)], np.int64)
        words, lengths = [], []
        for text in as_bytes(part.column("text")):
            found = terms_of(text)
            words += found
            lengths.append(len(found))
        ids = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        in_doc, times = np.unique(np.repeat(np.arange(len(lengths)) << 32, lengths) | ids, return_counts=True)
        self.put(of_doc[in_doc >> 32] << 32 | in_doc & 0xFFFFFFFF, times, np.ones_like(times))

    def put(self, keys: np.ndarray, n: np.ndarray, docs: np.ndarray) -> None:
        found, at = np.unique(keys, return_inverse=True)
        self.keys.append(found)
        for held, values in ((self.n, n), (self.docs, docs)):
            sums = np.zeros(len(found), np.int64)
            np.add.at(sums, at, values)
            held.append(sums)

    def rows(self) -> pa.RecordBatch:
        """What is held, and a row without a term for each group."""
        if self.keys:
            keys, n, docs = (np.concatenate(x) for x in (self.keys, self.n, self.docs))
            self.keys, self.n, self.docs = [], [], []
            self.put(keys, n, docs)
        keys, n, docs = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (self.keys, self.n, self.docs))
        names, none = list(self.groups), np.zeros(len(self.groups), np.int64)
        spelled = pa.array(list(self.numbers), pa.binary()).cast(pa.string())
        term = pa.concat_arrays([spelled.take(pa.array(keys & 0xFFFFFFFF)), pa.nulls(len(names), pa.string())])
        group = pa.array(np.concatenate([keys >> 32, np.arange(len(names))]))
        columns = [pa.array([x[k] for x in names], pa.string()).take(group) for k in (0, 1)] + [term, pa.array(np.concatenate([n, none])), pa.array(np.concatenate([docs, none]))]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, term, n, docs``: occurrences of each term in each group, and documents that hold it.

    Each group also has a row with a null term, so that groups without terms are known.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for batch in batches:
            for part in by_bytes(batch, "text", SLICE_BYTES):
                held.add(part)
                if held.full:
                    yield held.rows()
                    held = _Held()
        yield held.rows()

    plain = docs.select(*(F.coalesce(quoted(c).cast("string"), F.lit("")).alias(name) for c, name in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))))
    found = map_batches(plain, run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(times: Column, total: Column) -> Column:
    """1 + floor(10^9 times / total) for 0 < times <= total, in steps of a thousand that can't overflow."""
    rest, value = times, F.lit(0)
    for step in (1, 1000, 1000, 1000):
        value = value * step + F.call_function("div", rest * step, total)
        rest = (rest * step) % total
    return value + 1


def shares(times: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``share`` for arrays."""
    rest, value = times, np.zeros_like(times)
    for step in (1, 1000, 1000, 1000):
        value = value * step + rest * step // total
        rest = rest * step % total
    return value + 1


def _cell(rows: pa.Table) -> pa.Table:
    """``lang, source, item, value``: what the cell's terms add to each of its ordered pairs.

    Rows without a term tell a group: its block, its total, and the number of terms in the term block.
    """
    is_group = rows.column("term").is_null().to_numpy()
    heads, body = rows.filter(pa.array(is_group)), rows.filter(pa.array(~is_group))
    names = heads.column("source").to_pylist()
    number = {name: k for k, name in enumerate(names)}
    block, total = heads.column("block").to_numpy(), heads.column("n").to_numpy()
    a, b, terms = rows.column("a")[0].as_py(), rows.column("b")[0].as_py(), heads.column("terms")[0].as_py()
    found, place = np.unique(body.column("term").to_numpy(), return_inverse=True)
    seen = np.zeros((len(names), len(found)), np.int64)
    sources = body.column("source").combine_chunks().dictionary_encode()
    of = np.array([number[x] for x in sources.dictionary.to_pylist()], np.int64)
    seen[of[sources.indices.to_numpy(zero_copy_only=False)], place] = body.column("n").to_numpy()
    total = np.maximum(total, 1)[:, None]
    p = np.hstack([shares(seen + 1, total), shares(np.ones_like(total), total)])
    weight = np.append(np.ones(seen.shape[1], np.int64), terms - seen.shape[1])
    left, right = np.flatnonzero(block == a), np.flatnonzero(block == b)
    source, item, value = [], [], []
    for g in left:
        others = right[right > g] if a == b else right
        gap = (p[g] - p[others]) ** 2
        for one, other, sums in ((np.full(len(others), g), others, gap // p[others] @ weight), (others, np.full(len(others), g), gap // p[g] @ weight)):
            source += [names[k] for k in one]
            item += [names[k] for k in other]
            value += sums.tolist()
    lang = [rows.column("lang")[0].as_py()] * len(source)
    return pa.table({"lang": pa.array(lang, pa.string()), "source": pa.array(source, pa.string()), "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64())})


def _block(name: str, blocks: str) -> Column:
    return F.pmod(F.xxhash64(name), F.col(blocks)).cast("int")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, groups: int = GROUPS, terms: int = TERMS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, part, item, value, rank``; see the module for the parts ``pair`` and ``term``.

    In ``pair`` item is each other source of the language; in ``term`` it is each of the
    ``top_terms`` kept terms that the source has more of than its language.
    """
    counts = written(term_counts(docs, text_col, lang_col, source_col), "divergence-counts")
    kept = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= min_docs)
    kept = written(kept.select("lang", "term", "lang_n", F.monotonically_increasing_id().alias("number")), "divergence-kept")
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    own = written(counts.where("term IS NOT NULL").join(kept, ["lang", "term"]).select("lang", "source", "term", "number", "n", "lang_n"), "divergence-own")
    of_group = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    known = counts.where("term IS NULL").select("lang", "source")
    blocks = known.groupBy("lang").agg(F.ceil(F.count("*") / groups).alias("blocks")).join(of_lang, "lang", "left")
    blocks = checkpointed(blocks.select("lang", "blocks", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"), F.greatest(F.ceil(F.col("v") / terms), F.lit(1)).alias("term_blocks")))
    blocks = small_or_not(blocks, FEW_ROWS)
    about = known.join(of_group, ["lang", "source"], "left").na.fill(0, ["total"]).join(blocks, "lang")
    about = checkpointed(about.withColumn("block", _block("source", "blocks")))
    own = own.join(small_or_not(about, FEW_ROWS), ["lang", "source"])

    in_block = kept.join(blocks.select("lang", "term_blocks"), "lang").groupBy("lang", _block("number", "term_blocks").alias("t")).agg(F.count("*").alias("terms"))
    heads = about.select("lang", "source", "block", "blocks", (F.col("total") + F.col("v")).alias("n"), F.explode(F.sequence(F.lit(0), F.col("term_blocks").cast("int") - 1)).alias("t"))
    heads = heads.join(in_block, ["lang", "t"], "left").select("lang", "source", "block", "blocks", "t", F.lit(None).cast("long").alias("term"), "n", F.coalesce("terms", F.lit(0)).alias("terms"))
    body = own.select("lang", "source", "block", "blocks", _block("number", "term_blocks").alias("t"), F.col("number").alias("term"), "n", F.lit(None).cast("long").alias("terms"))
    met = heads.unionByName(body).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    cells = met.select("lang", F.least("block", "with").alias("a"), F.greatest("block", "with").alias("b"), "t", "source", "block", "term", "n", "terms")
    sums = cells.groupBy("lang", "a", "b", "t").applyInArrow(_cell, "lang string, source string, item string, value long")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    p, q = share(F.col("n") + 1, F.col("total") + F.col("v")), share(F.col("lang_n") + 1, F.col("lang_total") + F.col("v"))
    above = own.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    above = above.select("lang", "source", "item", F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(above, "term").where(F.col("rank") <= top_terms))


def _sql_share(times: str, total: str) -> str:
    return f"1 + ({SCALE} * {times}::HUGEINT) // {total}"


#: DuckDB: the same counts, every pair of sources over all kept terms, and the terms above the language's share.
ORACLE = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words
  FROM documents),
occurrences AS (SELECT r, lang, source, unnest(words) AS term FROM docs),
kept AS (SELECT lang, term, count(*)::HUGEINT AS lang_n FROM occurrences GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCS}),
langs AS (SELECT g.lang, count(k.term)::HUGEINT AS v, coalesce(sum(k.lang_n), 0)::HUGEINT AS lang_total
          FROM (SELECT DISTINCT lang FROM docs) g LEFT JOIN kept k ON k.lang = g.lang GROUP BY g.lang),
counts AS (SELECT o.lang, o.source, o.term, count(*)::HUGEINT AS n FROM occurrences o JOIN kept k ON k.lang = o.lang AND k.term = o.term GROUP BY ALL),
groups AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total
           FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
given AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
                 {_sql_share("(coalesce(c.n, 0) + 1)", "(g.total + l.v)")} AS p,
                 {_sql_share("(k.lang_n + 1)", "(l.lang_total + l.v)")} AS q
          FROM groups g JOIN langs l ON l.lang = g.lang JOIN kept k ON k.lang = g.lang
          LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
parts AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(d.value, 0)::BIGINT AS value
  FROM groups g JOIN groups h ON h.lang = g.lang AND h.source <> g.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
             FROM given a JOIN given b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) d
    ON d.lang = g.lang AND d.source = g.source AND d.item = h.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM given WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
