"""Byte-level BPE encoding and decoding.

Encoder: the longest vocabulary token at each place of a word comes from an Aho-Corasick automaton; tokens are taken
longest first, each checked against the table of compatible neighbours, with a step back where none fits. A sequence
whose neighbours are all compatible is the one that the merges make, so the result is exact, in linear time.
Decoder: a table of offsets into the joined bytes of all tokens; ids are expanded with one gather.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType

from .common import slices

#: Fixed by the vocabulary format: how its byte-level pre-tokenizer splits a text into words.
WORD = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: A space that isn't the start of a word. Without one, a text can be cut before each space.
ODD_SPACE = re.compile(r" (?=\s|\Z)")
#: Entries of each cache of words; then only those used since are kept.
CACHE = 1 << 17
#: Tables by vocabulary, kept in the Python worker from task to task.
_LOADED: dict[str, Codec] = {}


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Recent:
    """A bounded cache: what wasn't used while the newer half filled up is dropped."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most // 2, {}, {}

    def get(self, key: str) -> bytes | None:
        got = self.old.get(key)
        if got is not None:
            self.put(key, got)
        return got

    def put(self, key: str, value: bytes) -> None:
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        self.new[key] = value


class Codec:
    """Encodes and decodes with a byte-level BPE vocabulary in the tokenizers library's JSON format."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        vocab, merges = data["model"]["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in data["model"]["merges"]]
        self.letters = byte_letters()
        self.from_byte = dict(enumerate(self.letters))
        if data.get("normalizer") or (data.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or data["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("a byte-level vocabulary without normalizer and prefix space is needed")
        if any(vocab[a + b] != 256 + i for i, (a, b) in enumerate(merges)):
            raise ValueError("ids must follow the order of the merges")
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.vocab, self.merges, self.automaton = vocab, merges, None
        raw, to_byte = [b""] * size, {c: i for i, c in enumerate(self.letters)}
        for token, i in vocab.items():
            raw[i] = bytes(to_byte[c] for c in token)
        for token, i in self.special.items():
            raw[i] = token.encode()
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(raw), np.uint8)

    def _prepare(self) -> None:
        """The encoder's tables; a worker that only decodes doesn't need them."""
        size = len(self.offsets) - 1
        self.left, self.right = list(range(size)), list(range(size))
        self.pair: dict[tuple[int, int], int] = {}
        for i, (a, b) in enumerate(self.merges):
            self.left[256 + i], self.right[256 + i] = self.vocab[a], self.vocab[b]
            self.pair[self.vocab[a], self.vocab[b]] = 256 + i
        self.automaton, self.length, self.shorter = ahocorasick.Automaton(), [0] * size, [-1] * size
        for token, i in self.vocab.items():
            self.automaton.add_word(token, i)
            self.length[i] = len(token)
            for k in range(len(token) - 1, 0, -1):
                if (p := self.vocab.get(token[:k])) is not None:
                    self.shorter[i] = p
                    break
        self.automaton.make_automaton()
        self.vocab, self.merges = {}, []
        self.compatible: dict[tuple[int, int], bool] = {}
        self.words, self.pieces = Recent(2 * CACHE), Recent(CACHE)

    def fits(self, a: int, b: int) -> bool:
        """Whether the merges leave a and b as neighbours: no earlier merge joins the tokens that meet at their border."""
        got = self.compatible.get((a, b))
        if got is None:
            if len(self.compatible) > 2 * CACHE:
                self.compatible.clear()
            got = self.compatible[a, b] = self._fits(a, b)
        return got

    def _fits(self, a: int, b: int) -> bool:
        limit = 1 << 62
        while True:
            if self.pair.get((a, b), limit) < limit:
                return False
            if a > b:
                limit, a = a, self.right[a]
                if a == limit:
                    limit, b = b + 1, self.left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, self.left[b]
                if b + 1 == limit:
                    limit, a = a, self.right[a]
                    if a == limit:
                        return True

    def _word(self, word: str) -> list[int]:
        """The ids of one word, given in the vocabulary's letters."""
        n, length, shorter, compatible = len(word), self.length, self.shorter, self.compatible
        longest = [0] * n
        for end, token in self.automaton.iter(word):  # a later end from one start is a longer token
            longest[end - length[token] + 1] = token
        last = longest[0]
        if length[last] == n:
            return [last]
        out, at, closed = [last], length[last], set()
        token = longest[at]
        while at < n:
            while True:
                end = at + length[token]
                if end not in closed:
                    if not out:
                        break
                    fits = compatible.get((out[-1], token))
                    if fits if fits is not None else self.fits(out[-1], token):
                        break
                token = shorter[token]
                if token < 0:
                    break
            if token < 0:  # nothing fits behind the last token: take a shorter one in its place
                closed.add(at)
                token = out.pop()
                at -= length[token]
            else:
                out.append(token)
                at = end
                token = longest[at] if at < n else 0
        return out

    def _piece(self, text: str) -> bytes:
        out = []
        words = self.words
        for word in WORD.findall(text):
            ids = words.new.get(word)
            if ids is None:
                ids = words.get(word)
                if ids is None:
                    ids = array("i", self._word(word.encode().decode("latin-1").translate(self.from_byte))).tobytes()
                    words.put(word, ids)
            out.append(ids)
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        if ODD_SPACE.search(text):
            return self._piece(text)
        first, *rest = text.split(" ")
        known = self.pieces.new
        found = [known.get(x) for x in rest]
        if None in found:
            for i, x in enumerate(found):
                if x is None:
                    word = rest[i]
                    ids = self.pieces.get(word)
                    if ids is None:
                        ids = self._piece(" " + word)
                        if len(word) < 100:
                            self.pieces.put(word, ids)
                    found[i] = ids
        return self._piece(first) + b"".join(found)

    def encode(self, text: str) -> np.ndarray:
        if self.automaton is None:
            self._prepare()
        if self.split_special is None or not any(s in text for s in self.special):
            return np.frombuffer(self._plain(text), "<i4")
        parts = self.split_special.split(text)
        return np.frombuffer(b"".join(np.array([self.special[x]], "<i4").tobytes() if x in self.special else self._plain(x) for x in parts if x), "<i4")

    def decode(self, ids: np.ndarray) -> str:
        start = self.offsets[ids]
        size = self.offsets[ids + 1] - start
        end = np.cumsum(size)
        total = int(end[-1]) if len(ids) else 0
        return self.blob[np.arange(total) + np.repeat(start - end + size, size)].tobytes().decode("utf-8", "replace")


def codec(spec: str) -> Codec:
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Codec(spec)
    return _LOADED[key]


def _joined(arrays: list[np.ndarray]) -> pa.Array:
    sizes = np.cumsum([0, *(len(x) for x in arrays)])
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *arrays]), pa.int32()))


def encode(docs: DataFrame, vocabulary: str | Path, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the token ids of a column of texts; null counts as empty and has no ids.

    vocabulary: path of a JSON file, read on the driver and broadcast (its size is that of a vocabulary, whatever the
    corpus). Texts are encoded whole. A column named ids is replaced; other columns and repeated rows stay.
    """
    spec = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text())
    kept = [c for c in docs.columns if c.lower() != ids.lower()]
    schema = docs.select(*kept).schema.add(ids, ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(spec.value)
        for b in slices(batches):
            rows = [c.encode(t or "") for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), _joined(rows)], names=[*kept, ids])

    return docs.select(*kept).mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: str | Path, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """encoded with the text of a column of ids; null and empty ids give an empty text. A column named text is replaced."""
    spec = encoded.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text())
    kept = [c for c in encoded.columns if c.lower() != text.lower()]
    schema = encoded.select(*kept).schema.add(text, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(spec.value)
        for b in slices(batches):
            column = b.column(ids)
            flat, ends = np.asarray(column.flatten()), np.cumsum(np.asarray(column.value_lengths().fill_null(0)))
            rows = [c.decode(flat[i:j]) for i, j in zip(np.append(0, ends[:-1]), ends, strict=True)] if len(ends) else []
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), pa.array(rows, pa.string())], names=[*kept, text])

    return encoded.select(*kept).mapInArrow(run, schema)
