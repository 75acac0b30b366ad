"""Language identification (op 9): multinomial naive Bayes over hashed character n-grams.

Training counts n-grams per language over a sample of about ``train_rows`` training
rows (None: all rows). All labelled rows are counted by language first, and each
language gives an equal number, taken by a hash of the id; one that has fewer gives all
that it has, and what it leaves is shared by the others. Priors are the languages'
shares of all labelled rows. Tasks count in numpy and
emit one row per (language, bucket) that they saw, Spark sums them, and the driver
receives languages x ``buckets`` numbers, a size fixed by parameters. Log
probabilities are broadcast as one matrix. A batch is a sparse matrix of documents and
n-grams, one entry for each position; scoring multiplies it with the broadcast matrix,
in blocks of ``CELLS`` numbers, so that neither a very long text nor many languages take
more memory.

Defined results: null or letterless text gives ``und`` with score 0; ties go to the
language that sorts first; without training rows every text is ``und``, and nothing is
kept; of more than ``max_languages`` labels the most frequent are learned (ties: those
that sort first), and rows with others aren't trained on; rows without an id aren't; repeated rows count, and are predicted, each for itself; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, held_out, keep_rows, map_batches

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Training rows, about; beyond it a share of each language's ids is taken by hash.
TRAIN_ROWS = 20_000
MAX_LANGUAGES = 256
SLICE_BYTES = 1 << 20
#: Numbers held at once while n-grams are looked up: positions of a text times languages.
CELLS = 1 << 21
_LETTER = regex.compile(r"\p{L}").search
_MULTIPLIERS = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, each between two spaces, and where each begins."""
    joined = [f" {t.lower()} " for t in texts]
    starts = np.concatenate(([0], np.cumsum([len(t) for t in joined])))
    return np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), np.uint32), starts


def _hashes(codes: np.ndarray, order: int, buckets: int) -> np.ndarray:
    """Bucket of the n-gram that begins at each position (``order`` - 1 fewer than codes)."""
    n = max(0, len(codes) - order + 1)
    h = np.full(n, order, np.uint32)
    for i in range(order):
        h *= np.uint32(_MULTIPLIERS[0])
        h ^= codes[i : i + n]
        h *= np.uint32(_MULTIPLIERS[1])
    return (h >> np.uint32(7)) % np.uint32(buckets)


def quotas(counted: dict[str, int], rows: int) -> dict[str, int]:
    """Rows that each language gives: as equal as their numbers allow, ``rows`` in all at most, and one at least."""
    taken: dict[str, int] = {}
    for place, lang in enumerate(sorted(counted, key=lambda x: (counted[x], x))):
        taken[lang] = min(counted[lang], max(1, (rows - sum(taken.values())) // (len(counted) - place)))
    return taken


def hash_limit(share: float) -> int:
    """Hashes of 63 bits below this are a share of all; above zero however small the share."""
    return max(1, min((1 << 63) - 1, int(share * 2.0**63)))


class Model(NamedTuple):
    """Languages in order, log probabilities with a row for each bucket, and log priors."""

    languages: list[str]
    matrix: np.ndarray
    priors: np.ndarray


def train(docs: DataFrame, buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS, smoothing: float = 0.5, max_languages: int = MAX_LANGUAGES, train_rows: int | None = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of the rows that are not held out and have a text and a language; only those are read."""
    usable = ~held_out(id_col) & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()
    source = docs.where(usable).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    found = source.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages + 1).collect()
    counted = {r["lang"]: r["n"] for r in found[:max_languages]}
    languages = sorted(counted)
    if len(found) > max_languages:
        usable &= F.col(lang_col).isin(languages)
        source = source.where(F.col("lang").isin(languages))
    if train_rows is not None and sum(counted.values()) > train_rows:
        taken = quotas(counted, train_rows)
        limits = F.create_map(*(F.lit(x) for lang in languages for x in (lang, hash_limit(taken[lang] / counted[lang]))))
        chosen = F.shiftrightunsigned(F.xxhash64(id_col), 1) <= F.try_element_at(limits, F.col(lang_col))
        source = docs.where(chosen).where(usable).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    place = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(place), buckets), np.int64)
        for batch in batches:
            for part in by_bytes(batch, "text", SLICE_BYTES):
                by_language: dict[str, list[str]] = {}
                for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), strict=True):
                    by_language.setdefault(lang, []).append(text)
                for lang, texts in by_language.items():
                    codes, starts = _codes(texts)
                    for order in orders:
                        crossing = (starts[1:-1, None] - np.arange(1, order)).ravel()  # they run on into the next text
                        for a in range(0, max(0, len(codes) - order + 1), CELLS):
                            found = _hashes(codes[a : a + CELLS + order - 1], order, buckets)
                            own = crossing[(crossing >= a) & (crossing < a + len(found))] - a
                            counts[place[lang]] += np.bincount(np.delete(found, own), minlength=buckets)
        lang, bucket = counts.nonzero()
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(bucket, pa.int32()), pa.array(counts[lang, bucket])], names=["lang", "bucket", "n"])

    counts = np.zeros((len(languages), buckets))
    summed = map_batches(source, run, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts[summed.column("lang").to_numpy(), summed.column("bucket").to_numpy()] = summed.column("n").to_numpy()
    smoothed = counts + smoothing
    number = np.array([counted[x] for x in languages], float)
    return Model(languages, np.ascontiguousarray(np.log(smoothed / smoothed.sum(axis=1, keepdims=True)).T.astype(np.float32)), np.log(number / number.sum()) if languages else number)


def predict(docs: DataFrame, model: Model, orders: tuple[int, ...] = ORDERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every column of ``docs`` is dropped but the id and text; adds ``held_out, lang_pred, score``."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text", SLICE_BYTES):
                texts = [t or "" for t in part.column("text").to_pylist()]
                pred, score = _score(texts, shared.value, orders)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "held_out")), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"))
    return map_batches(source, run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def _score(texts: list[str], model: Model, orders: tuple[int, ...]) -> tuple[list[str], list[float]]:
    names, logp, priors = model
    if not names:
        return ["und"] * len(texts), [0.0] * len(texts)
    codes, starts = _codes(texts)
    total = np.tile(priors, (len(texts), 1))
    block = max(1, CELLS // len(names))
    for a in range(0, len(codes), block):
        size = min(block, len(codes) - a)
        each = np.zeros((size, len(names)), np.float32)
        ends = starts[1:-1][(starts[1:-1] > a) & (starts[1:-1] < a + size + max(orders))] - a
        for order in orders:
            rows = _hashes(codes[a : a + size + order - 1], order, len(logp))
            found = logp.take(rows, axis=0)
            for back in range(1, order):  # n-grams that run on into the next text don't count
                crossing = ends - back
                found[crossing[(crossing >= 0) & (crossing < len(found))]] = 0
            each[: len(rows)] += found
        first = int(np.searchsorted(starts, a, side="right")) - 1
        begins = np.concatenate(([0], ends[ends < size]))
        total[first : first + len(begins)] += np.add.reduceat(each, begins, axis=0, dtype=np.float64)
    total -= total.max(axis=1, keepdims=True)
    share = np.exp(total)
    share /= share.sum(axis=1, keepdims=True)
    best = share.argmax(axis=1)
    letters = [_LETTER(t) is not None for t in texts]
    return [names[b] if ok else "und" for b, ok in zip(best, letters, strict=True)], [float(s[b]) if ok else 0.0 for s, b, ok in zip(share, best, letters, strict=True)]


def identify(docs: DataFrame, **options) -> DataFrame:
    """Train on the rows of ``docs`` that are not held out, then predict every row."""
    return predict(docs, train(docs, **options))


def keep_identified(docs: DataFrame, least: float = 0.4, **options) -> DataFrame:
    """``docs`` without the rows whose language is ``und`` or scores below ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, **options))
    orders = options.get("orders", ORDERS)

    def keep(texts: list[str]) -> list[bool]:
        names, scores = _score(texts, shared.value, orders)
        return [n != "und" and s >= least for n, s in zip(names, scores, strict=True)]

    return keep_rows(docs, keep, SLICE_BYTES)
