"""Toxicity (op 4): a subsequence string-kernel SVM with Nystrom landmarks.

A text is a bag of units, its words; runs of single characters ("i d i o t") are one
unit. The kernel of two units is the gap-weighted count of common subsequences of
three characters: an occurrence that spans s characters weighs ``DECAY ** s``, and
spans end at ``SPAN``. Characters between the three only cost weight, so inserted and
missing letters are tolerated; marks inside a word are skipped. Letters are compared
without case and in their compatible form, so full-width and mathematical letters are
the letters that they show; each unit has a marker character at its start and end.
Kernels are scaled by units' lengths.

Training is multiple-instance: labels belong to texts, so each toxic text is
represented by its few most suspicious units (at first by support among toxic against clean
texts, then by the model's own score), and clean texts by their most suspicious and by
random units. Landmark units give Nystrom features, a squared-hinge SVM is fitted to
them, and since the kernel's features can be written out, the machine sum(a_l K(x, l))
collapses into one weight per character triple; scoring needs no landmark loop. A
text is summed up by the margins of its ``TOP`` worst units and its number of units; a
second half of the sample calibrates them to a probability.

The sample is bounded: ``per_class`` labelled texts of either class with the smallest
id hashes, each of at most ``train_bytes`` bytes. Scoring covers every whole text.

Defined results: null or empty text, and text without a unit of three characters, has
the margins of units that match nothing; without both labels in the training rows, or
in an empty table, every score is 0; repeated labels of a document count as toxic if one
is; null and other labels are no labels; repeated rows, and rows without an id, are
scored each for itself; other columns are ignored (``remove_toxic`` keeps them).
Letters that share a class (see ``OTHERS``) are alike to the kernel.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, held_out, keep_rows, map_batches

DECAY, SPAN, NORM_LENGTH = 0.7, 8, 12
LANDMARKS, ROUNDS, WITNESSES, TOP, FLOOR = 240, 5, 3, 3, -4.0
PER_CLASS, TRAIN_BYTES = 1600, 20_000
SLICE_BYTES = 1 << 20
#: Characters of a very long text that are scored at once; and a place between units, neither of them a single character run.
PART_CHARS, _BETWEEN = 1 << 20, re.compile(r"\s(?=\S\S)")
#: Character classes: 1-26 letters, 27 digits, 28-60 other letters, 62 start or end of a unit, 63 marks.
DIGIT, OTHER, OTHERS, START, MARK, BITS = 27, 28, 33, 62, 63, 6
FEATURES = 1 << (3 * BITS)
#: Code points that have a class of their own kind.
CODES = 0x20000


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    table = np.full(CODES + 1, MARK, np.int32)
    table[CODES] = OTHER  # all beyond: rare letters of East Asia
    for code in range(CODES):
        char, same = chr(code), unicodedata.normalize("NFKC", chr(code))
        char = (same if char.isalpha() and len(same) == 1 else char).lower()
        if char.isspace():
            table[code] = START
        elif char.isdigit():
            table[code] = DIGIT
        elif char.isalpha():
            table[code] = ord(char) - 96 if "a" <= char <= "z" else OTHER + ord(char[0]) % OTHERS
    return table


def _units(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of all characters (a last marker ends the last unit), where each unit starts, and the first unit of each text."""
    lengths = np.array([len(t) + 1 for t in texts])
    codes = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    classes = _classes()[np.minimum(codes, CODES)]
    text_starts = np.cumsum(lengths) - lengths
    starts = np.flatnonzero(classes[:-1] == START)
    size = np.diff(np.append(starts, len(classes) - 1)) - 1
    joined = np.zeros(len(starts), bool)
    joined[1:] = (size[1:] == 1) & (size[:-1] == 1)
    joined[np.searchsorted(starts, text_starts)] = False
    classes = classes.copy()
    classes[starts[joined]] = MARK
    starts = starts[~joined]
    firsts = np.searchsorted(starts, text_starts)
    kept = classes != MARK
    place = np.cumsum(kept) - 1
    return classes[kept], place[starts], firsts


def _parts(text: str, limit: int) -> Iterator[str]:
    """A text in parts of about ``limit`` characters that hold its units between them.

    Runs of single characters are one unit, so cuts are before longer words only.
    """
    at = 0
    while len(text) - at > limit and (cut := _BETWEEN.search(text, at + limit)):
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


@lru_cache(maxsize=1)
def _scale() -> np.ndarray:
    """By a unit's length: the norm that it has if its subsequences are all different."""
    out = np.ones(NORM_LENGTH + 1)
    for n in range(3, NORM_LENGTH + 1):
        out[n] = np.sqrt(sum((s - 2) * (n - s + 1) * DECAY ** (2 * s) for s in range(3, min(SPAN, n) + 1)))
    return out


def _margins(classes: np.ndarray, starts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each unit the sum of its triples' weights, scaled by its length."""
    n, total = len(classes), np.zeros(len(classes), np.float32)
    begins = np.zeros(n, np.int32)
    begins[starts[1:]] = begins[-1] = 1
    unit = np.cumsum(begins, dtype=np.int32)
    ends_in = unit - begins  # a unit's start is also the end of the one before
    for s in range(3, min(SPAN, n) + 1):
        outer = (classes[: n - s + 1] << (2 * BITS)) | classes[s - 1 :]
        part = weights.take(outer | (classes[1 : n - s + 2] << BITS))
        for m in range(2, s - 1):
            part += weights.take(outer | (classes[m : n - s + 1 + m] << BITS))
        part *= np.float32(DECAY**s)
        part *= unit[: n - s + 1] == ends_in[s - 1 :]
        total[: n - s + 1] += part
    plain = np.diff(np.append(starts, n - 1)) + 1
    return np.add.reduceat(total[:-1], starts, dtype=np.float64) / _scale()[np.minimum(plain, NORM_LENGTH)]


def _triples(units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit, feature and value of every subsequence of the units (class strings)."""
    rows, cols, vals = [], [], []
    for row, unit in enumerate(units):
        c = np.append(np.frombuffer(unit, np.uint8), START).astype(np.int32)
        scale = _scale()[min(len(c), NORM_LENGTH)]
        for s in range(3, min(SPAN, len(c)) + 1):
            last = len(c) - s + 1
            for m in range(1, s - 1):
                rows.append(np.full(last, row))
                cols.append((c[:last] << (2 * BITS)) | (c[m : last + m] << BITS) | c[s - 1 :])
                vals.append(np.full(last, DECAY**s / scale))
    if not rows:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(vals)


def _written(units: list[bytes], used: np.ndarray) -> np.ndarray:
    """The features ``used`` of each unit, written out."""
    rows, cols, vals = _triples(units)
    place = np.full(FEATURES, -1)
    place[used] = np.arange(len(used))
    shared = place[cols] >= 0
    out = np.zeros((len(units), len(used)))
    np.add.at(out, (rows[shared], place[cols[shared]]), vals[shared])
    return out


def _kernel(units: list[bytes], landmarks: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Kernels of units and landmarks, over the features that a landmark has."""
    return np.concatenate([_written(units[i : i + 1000], used) @ landmarks.T for i in range(0, len(units), 1000)])


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 10.0) -> np.ndarray:
    """Squared-hinge SVM by Newton steps; the last coefficient is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(30):
        active = y * (x @ w) < 1
        a, c = x[active], cost * weight[active]
        new = np.linalg.solve(ridge + (a * c[:, None]).T @ a, (a * c[:, None]).T @ y[active])
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w


def _calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Coefficients of a logistic model (the last is the offset), with a small ridge, by damped Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    p = np.zeros(x.shape[1])

    def loss(q: np.ndarray) -> float:
        return float(np.sum(weight * np.logaddexp(0, -y * (x @ q))) + 0.05 * q @ q)

    for _ in range(100):
        s = 1 / (1 + np.exp(np.clip(y * (x @ p), -500, 500)))
        gradient = -(x * (weight * y * s)[:, None]).sum(axis=0) + 0.1 * p
        hessian = (x * (weight * s * (1 - s))[:, None]).T @ x + 0.1 * np.eye(len(p))
        step, rate = np.linalg.solve(hessian, gradient), 1.0
        while rate > 1e-6 and loss(p - rate * step) > loss(p):
            rate /= 2
        p = p - rate * step
        if np.abs(rate * step).max() < 1e-9:
            break
    return p


class Model:
    """Weights of character triples, bias, and the calibration of a text's summary."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), bias
        self.curve = np.zeros(TOP + 2)

    def summary(self, texts: list[str], part_chars: int = PART_CHARS) -> np.ndarray:
        """For each text the margins of its worst units, and the logarithm of its number of units.

        Very long texts are read in parts, whose worst units and numbers are put together.
        """
        out = np.zeros((len(texts), TOP + 1))
        long = [i for i, t in enumerate(texts) if len(t) > part_chars]
        for i in long:
            parts = np.concatenate([self._worst([p]) for p in _parts(texts[i], part_chars)])
            out[i] = [*np.sort(parts[:, :TOP], axis=None)[::-1][:TOP], parts[:, TOP].sum()]
        if short := sorted(set(range(len(texts))) - set(long)):
            out[short] = self._worst([texts[i] for i in short])
        out[:, TOP] = np.log(out[:, TOP])
        return out

    def _worst(self, texts: list[str]) -> np.ndarray:
        """For each text the margins of its worst units, and its number of units."""
        classes, starts, firsts = _units(texts)
        margin = np.maximum(_margins(classes, starts, self.weights) + self.bias, FLOOR)
        number = np.diff(np.append(firsts, len(starts)))
        owner = np.repeat(np.arange(len(texts)), number)
        out = np.zeros((len(texts), TOP + 1))
        for k in range(TOP):
            out[:, k] = np.maximum.reduceat(margin, firsts)
            at = np.flatnonzero(margin == out[owner, k])
            margin[at[np.unique(owner[at], return_index=True)[1]]] = FLOOR
        out[:, TOP] = number
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        value = self.summary(texts) @ self.curve[:-1] + self.curve[-1]
        return 1 / (1 + np.exp(np.clip(-value, -500, 500)))


def _bags(texts: list[str]) -> list[list[bytes]]:
    """The distinct units of each text, as sorted strings of classes."""
    classes, starts, firsts = _units(texts)
    raw, ends = classes.astype(np.uint8).tobytes(), np.append(starts[1:], len(classes) - 1)
    units = [raw[a:b] for a, b in zip(starts, ends, strict=True)]
    bounds = np.append(firsts, len(units))
    return [sorted({u for u in units[a:b] if len(u) > 3}) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _unit_scores(units: list[bytes], weights: np.ndarray) -> np.ndarray:
    joined = np.append(np.frombuffer(b"".join(units), np.uint8), START).astype(np.int32)
    lengths = np.array([len(u) for u in units])
    return _margins(joined, np.cumsum(lengths) - lengths, weights.astype(np.float32))


def fit(toxic: list[str], clean: list[str], clean_share: float, landmarks: int = LANDMARKS, rounds: int = ROUNDS, seed: int = 7) -> Model:
    """Fit on labelled texts; ``clean_share`` is the true number of clean texts for a toxic one."""
    rng = np.random.default_rng(seed)
    bad, good = _bags(toxic[::2]), _bags(clean[::2])
    in_bad, in_good = Counter(u for b in bad for u in b), Counter(u for b in good for u in b)
    names = sorted(in_bad | in_good)
    support = np.array([in_bad[u] - 5 * in_good[u] * len(bad) / max(1, len(good)) for u in names])
    number = {u: i for i, u in enumerate(names)}
    bad_index = [np.fromiter((number[u] for u in b), int, len(b)) for b in bad if b]
    good_index = [np.fromiter((number[u] for u in b), int, len(b)) for b in good if b]
    value, least = support, 2.0
    weights, bias = np.zeros(FEATURES), -1.0
    ordered = np.array(sorted(in_good), object)
    common = sorted(in_good, key=lambda u: (-in_good[u], u))[:1000]
    for _ in range(rounds):
        worst = Counter(names[i] for b in bad_index for i in b[np.argsort(-value[b], kind="stable")[:WITNESSES]] if value[i] >= least)
        worst = Counter({u: n for u, n in worst.items() if in_good[u] * len(bad) <= 0.2 * in_bad[u] * len(good)})
        hard = {names[b[np.argmax(value[b])]] for b in good_index} if value is not support else set()
        pool = sorted(hard | set(common) | set(rng.choice(ordered, min(3000, len(ordered)), replace=False)) - set(worst)) if in_good else []
        if not worst or not pool:
            break
        marks = sorted(worst, key=lambda u: (-worst[u], u))[: landmarks * 2 // 3]
        marks += [pool[i] for i in rng.permutation(len(pool))[: landmarks - len(marks)]]
        used = np.unique(_triples(marks)[1])
        written = _written(marks, used)
        gram = written @ written.T
        eigen, vectors = np.linalg.eigh(gram + 1e-6 * np.eye(len(marks)))
        root = vectors / np.sqrt(np.maximum(eigen, 1e-6)) @ vectors.T
        units = [*worst, *pool]
        y = np.array([1.0] * len(worst) + [-1.0] * len(pool))
        weight = np.array([np.sqrt(n) for n in worst.values()] + [1.0] * len(pool))
        w = _svm(_kernel(units, written, used) @ root, y, weight)
        weights, bias = np.zeros(FEATURES), float(w[-1])
        weights[used] = written.T @ (root @ w[:-1])
        value, least = _unit_scores(names, weights) + bias, 0.0
    model = Model(weights, bias)
    held_bad, held_good = toxic[1::2] or toxic, clean[1::2] or clean
    seen = model.summary([*held_bad, *held_good])
    y = np.array([1.0] * len(held_bad) + [-1.0] * len(held_good))
    weight = np.where(y > 0, 1.0, clean_share * len(held_bad) / max(1, len(held_good)))
    model.curve = _calibrated(seen, y, weight)
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, train_bytes: int = TRAIN_BYTES) -> Model | None:
    """Fit on a bounded sample of labelled rows that are not held out."""
    known = labels.where(~held_out("doc_id") & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    numbers = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not (numbers.get(0) and numbers.get(1)):
        return None
    samples = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    ids = F.broadcast(samples[0].unionByName(samples[1]))
    rows = docs.where(F.octet_length("text") <= train_bytes).select("doc_id", "text").join(ids, "doc_id").select("text", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(4 * per_class).collect()
    toxic, clean = ([r["text"] for r in rows if r["toxic"] == k] for k in (1, 0))
    return fit(toxic, clean, numbers[0] / numbers[1]) if toxic and clean else None


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            for part in by_bytes(batch, "text", SLICE_BYTES):
                texts = [t or "" for t in part.column("text").to_pylist()]
                scores = fitted.scores(texts) if fitted else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"))
    return map_batches(source, run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def detect(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Train on labelled rows, then score every whole text of ``docs``."""
    return score(docs, train(docs, labels, **options))


def remove_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that are predicted toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **options))
    return keep_rows(docs, lambda texts: shared.value.scores(texts) < 0.5 if shared.value else [True] * len(texts), SLICE_BYTES)
