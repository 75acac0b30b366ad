"""Token counts (op 7): batch encoding in Arrow functions that returns lengths only.

The work is one map over the scan, without a shuffle. Each Arrow batch is cut into
slices of similar byte size. Texts are split at ASCII white space, which is a safe
boundary where the tokenizer never lets a token span white space: ``safe_splits``
says whether the vocabulary file has that property. For such a vocabulary every
distinct word of a slice is encoded once by the library and counts are summed, so
memory is bounded by the slice and by ``CACHE_WORDS``, however long a text is.
Other vocabularies get each whole text.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows give
repeated results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, by_bytes, kept, map_batches

#: Words held by a worker's cache, and the longest word that it keeps, in bytes.
CACHE_WORDS, CACHE_WORD_BYTES = 150_000, 48
#: Runs of marks at the ends of words that are held.
CACHE_ENDS = 10_000
#: Bytes of text encoded at once.
SLICE_BYTES = 4 << 20


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _library(path: str) -> tuple[Callable[[list[str]], list[list[int]]], bool, Callable | None]:
    """The file's batch encoder, whether white space is a safe place to split, and the
    library's encoder of lower-case letter runs where those are pieces."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: model.encode(texts, num_threads=1), False, None
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    return (
        lambda texts: [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)],
        safe_splits(spec),
        tokenizer.model.tokenize if safe_splits(spec) and letter_pieces(spec) else None,
    )


def safe_splits(spec: dict) -> bool:
    """True if the pre-tokenizer removes white space and matches it in no token.

    That holds for a first "Split" step that drops everything outside its pattern,
    where the pattern's only white-space class is negated, with a normalizer that
    works on characters or runs of white space, and added tokens without white space.
    """
    steps = spec.get("pre_tokenizer") or {}
    steps = steps.get("pretokenizers", [steps])
    first = steps[0] if steps else {}
    pattern = (first.get("pattern") or {}).get("Regex", " ")
    normal = spec.get("normalizer") or {"normalizers": []}
    normal = normal.get("normalizers", [normal])
    plain = all(x["type"] in ("NFC", "Lowercase") or (x["type"] == "Replace" and x["pattern"].get("Regex") == r"\s+" and x["content"] == " ") for x in normal)
    return (
        first.get("type") == "Split"
        and first.get("behavior") == "Removed"
        and first.get("invert") is True
        and not any(c.isspace() for c in pattern)
        and r"\s" not in pattern.replace(r"[^\s", "")
        and not any(x.get("add_prefix_space") for x in steps)
        and plain
        and not any(any(c.isspace() for c in t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", []))
    )


def letter_pieces(spec: dict) -> bool:
    """True if a lower-cased run of letters reaches the model as its bytes' characters, and added tokens can't lie in a plain word."""
    steps = spec["pre_tokenizer"].get("pretokenizers", [])
    return len(steps) == 2 and steps[0]["pattern"]["Regex"].endswith(_LETTER_RUNS) and steps[1]["type"] == "ByteLevel" and not steps[1].get("use_regex", True) and any(x["type"] == "Lowercase" for x in spec["normalizer"].get("normalizers", [])) and all("<" in t["content"] for t in spec.get("added_tokens", []))


def split_long(text: bytes, limit: int) -> Iterator[bytes]:
    """``text`` in parts of about ``limit`` bytes, cut before ASCII white space.

    A part without any white space stays whole.
    """
    while len(text) > limit:
        cut = max(text.rfind(c, 1, limit) for c in _SPACES)
        if cut < 1:
            found = _SPACE.search(text, limit)
            if not found:
                break
            cut = found.start()
        yield text[:cut]
        text = text[cut:]
    yield text


_SPACES = (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")
_SPACE = re.compile(rb"[ \t-\r]")
#: Words of Latin-1 letters (A-Z, a-z, U+00C0 to U+00FF without the two signs) and a run of marks.
_PLAIN = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:;=-@\[-`{-~]*)").fullmatch
#: A pre-tokenizer pattern with this end takes a run of letters as one piece.
_LETTER_RUNS = r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class TextEncoder:
    """Ids of whole texts, each distinct word of a slice going to the library once."""

    def __init__(self, path: str):
        self.encode, self.safe, self.tokenize = _library(path)
        #: words of late slices and of those before: what is asked for again stays, and the rest goes when the first is half full
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        if self.tokenize:
            from tokenizers.pre_tokenizers import ByteLevel

            show = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
            #: the characters that the model sees for the bytes of letters beyond ASCII
            self.shown = {ord(c): show(c)[0][0] for c in map(chr, range(0xC0, 0x100))}
            self.ends = {b"": b""}

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    def _learn(self, words: list[bytes]) -> None:
        known, rest = self.known, words
        if self.tokenize:
            rest, cores, ends, tokenize = [], {}, self.ends, self.tokenize
            for w in words:
                if len(w) <= CACHE_WORD_BYTES and (plain := _PLAIN(w)):
                    core, end = plain.groups()
                    ids = cores.get(core)
                    if ids is None:
                        letters = core.decode().lower()
                        ids = cores[core] = self._pack([t.id for t in tokenize(letters if core.isascii() else letters.translate(self.shown))])
                    if end not in ends:
                        if len(ends) > CACHE_ENDS:
                            ends.clear()
                        ends[end] = self._pack(self.encode([end.decode()])[0])
                    known[w] = ids + ends[end]
                else:
                    rest.append(w)
        for start in range(0, len(rest), 20_000):
            part = rest[start : start + 20_000]
            known.update(zip(part, map(self._pack, self.encode([w.decode("utf-8") for w in part])), strict=True))

    def slice(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Per text the end of its words, the words as numbers, and the packed ids by number."""
        if not self.safe:
            packed = [self._pack(x) for x in self.encode([t.decode("utf-8") for t in texts])]
            return np.arange(1, len(texts) + 1), np.arange(len(texts)), packed
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.large_binary()).to_pylist()
        if len(self.known) > CACHE_WORDS // 2:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = []
        for w in words:
            if w not in known:
                if w in older:
                    known[w] = older.pop(w)
                else:
                    new.append(w)
        self._learn(new)
        packed = [known[w] for w in words]
        for w in new:
            if len(w) > CACHE_WORD_BYTES:
                del known[w]
        return np.asarray(lists.offsets)[1:], np.asarray(coded.indices), packed

    def counts(self, texts: list[bytes]) -> np.ndarray:
        ends, index, packed = self.slice(texts)
        each = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        upto = np.concatenate(([0], np.cumsum(each[index])))
        return np.diff(upto[np.concatenate(([0], ends))])

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after another, and how many each has."""
        ends, index, packed = self.slice(texts)
        each = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        first = np.cumsum(each) - each
        flat = np.frombuffer(b"".join(packed), "<u4")
        per_word = each[index]
        upto = np.concatenate(([0], np.cumsum(per_word)))
        place = np.repeat(first[index] - upto[:-1], per_word) + np.arange(upto[-1])
        return flat[place], np.diff(upto[np.concatenate(([0], ends))])


def encoder(path: str) -> TextEncoder:
    """A worker's encoder for a vocabulary file, kept between tasks of operators that use it."""
    return kept(path, lambda: TextEncoder(path))


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``."""
    path = path or default_tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for part in by_bytes(batch, "text", SLICE_BYTES):
                texts = as_bytes(part.column("text"))
                if enc.safe and len(texts) == 1 and len(texts[0]) > SLICE_BYTES:
                    counts = np.array([sum(int(enc.counts([x])[0]) for x in split_long(texts[0], SLICE_BYTES))])
                else:
                    counts = enc.counts(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(counts, pa.int64()), pa.array(counts > limit)],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(source, run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean", path)
