"""Token-id files compressed by Re-Pair grammars (Larsson and Moffat, 2000), with random access.

Documents are put in the order of doc_id by range partitions, encoded with the tokenizers library, and written in shards
of bounded length. Each shard has a grammar: pairs of symbols that occur LEAST_COUNT times or more, not overlapping, are
replaced by nonterminals, until there is no such pair. Rules and expansion lengths are stored with the shard. A round
replaces many pairs at once: a place is replaced if its pair is more frequent than those that begin before and after it,
so the most frequent pair of all is replaced wherever it stands, and no round is without progress.

The file format is a Parquet table, a row for each shard:
  part, shard          place in the order: range partition, then number within it
  n_ids, before        ids of the shard, and of all shards before it in its range partition
  doc_ids, ends        per document its doc_id and the number of ids up to its end within the shard
  first                the smallest nonterminal; smaller symbols are token ids
  left, right, length  per nonterminal the two symbols of its rule (earlier ones or token ids) and its expansion's length
  symbols              the compressed sequence, little-endian unsigned 32-bit
To read ids i to j, the running sum of the symbols' lengths gives the symbols that cover them; only those are expanded.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from tokenizers import Tokenizer

from .bpe import Recent, byte_letters
from .common import slices_of_bytes

#: Id appended to every document.
END = 1
#: Ids of a shard, about: a document is never cut. Bounds the memory of a task, to some 60 bytes an id.
SHARD_IDS = 1 << 19
#: Occurrences that a pair needs: a rule takes the room of three symbols, so from four on it pays.
LEAST_COUNT = 4
#: Words and parts of words that a worker remembers; then only those used since are kept.
CACHE = 1 << 19
#: Bytes of text that are encoded at a time.
AT_ONCE = 4 << 20
#: Symbols are expanded from a table of all rules' ids if that has at most 2^20, or so many for each symbol; else level by level.
TABLE = 8
#: Fixed by the vocabulary: the pattern that its pre-tokenizer finds parts of words with, after lower-casing.
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Marks that are a part of their own where one ends a word.
_MARKS = frozenset(".,;:!?")
_LOADED: dict[str, WordCoder] = {}


class WordCoder:
    """The tokenizers library, asked once for each different part of a word.

    That needs a vocabulary that drops white space and whose tokens don't span two parts, as the pre-tokenizer below says:
    a text's ids are then those of its words' parts. Texts in which a word could come out otherwise alone, and all texts
    of any other vocabulary, go to the library whole.
    """

    def __init__(self, spec: str):
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        said = json.loads(spec)
        normalizer, pre, model = said.get("normalizer") or {}, said.get("pre_tokenizer") or {}, said["model"]
        self.by_word = (
            normalizer == {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
            and pre == {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _PARTS.pattern}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
            and model["type"] == "BPE"
            and not model.get("dropout")
        )
        # characters on which words are cut but the tokenizer doesn't, and the strings of added tokens
        self.odd = "|".join(["[\x1c-\x1f]", *(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())])
        self.from_byte = dict(enumerate(byte_letters()))
        self.known = Recent(CACHE)  # words as they stand, and parts in lower case

    def _whole(self, text: str | None) -> np.ndarray:
        return np.array(self.tokenizer.encode(text or "", add_special_tokens=False).ids, np.uint32)

    def _part(self, part: str) -> bytes:
        key = part if part.isascii() else f" {part}"  # as a word, what isn't ASCII may be normalised to something else
        ids = self.known.new.get(key)
        if ids is None:
            ids = self.known.get(key)
            if ids is None:
                letters = part if part.isascii() else part.encode().decode("latin-1").translate(self.from_byte)
                ids = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
                self.known.put(key, ids)
        return ids

    def _word(self, word: str) -> bytes:
        if word.isascii():
            lower = word.lower()
        else:
            word = unicodedata.normalize("NFC", word)
            lower = word.lower() if "\u03a3" not in word else "".join(c.lower() for c in word)
        if lower.isalpha():
            return self._part(lower)
        if lower[-1:] in _MARKS and lower[:-1].isalpha():
            return self._part(lower[:-1]) + self._part(lower[-1])
        return b"".join(map(self._part, _PARTS.findall(lower)))

    def _by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all texts after each other, and where each text's end."""
        split = pc.utf8_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        known, cache = [], self.known
        for w in coded.dictionary.to_pylist():
            ids = cache.new.get(w)
            if ids is None:
                ids = cache.get(w)
                if ids is None:
                    ids = self._word(w)
                    cache.put(w, ids)
            known.append(ids)
        table, size = np.frombuffer(b"".join(known), "<u4"), np.array([len(x) // 4 for x in known], np.int64)
        n = size[coded.indices.to_numpy()] if len(known) else np.empty(0, np.int64)
        upto = np.append(0, np.cumsum(n))
        ends = upto[np.cumsum(pc.list_value_length(split).to_numpy())]
        if not len(n):
            return np.empty(0, np.uint32), ends
        begin = (np.cumsum(size) - size)[coded.indices.to_numpy()]
        return table[np.repeat(begin - upto[:-1], n) + np.arange(upto[-1])], ends

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        texts = texts.cast(pa.large_string()).fill_null("")
        whole = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False) if self.by_word else np.ones(len(texts), bool)
        if whole.all():
            return [self._whole(t) for t in texts.to_pylist()]
        plain = pc.if_else(pa.array(whole), pa.scalar("", pa.large_string()), texts)
        ids, ends = self._by_words(plain)
        out = np.split(ids, ends[:-1])
        for i in np.flatnonzero(whole):
            out[i] = self._whole(texts[int(i)].as_py())
        return out


def coder(spec: str) -> WordCoder:
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = WordCoder(spec)
    return _LOADED[key]


def _grouped(s: np.ndarray, at: np.ndarray, bits: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, group, pairs): of the places at, those whose pair of symbols (of so many bits) stands at least times, pair by pair, in order."""
    one, place = np.uint64(bits), np.uint64(int(len(s)).bit_length())
    pair = s[at].astype(np.uint64) << one | s[at + np.uint32(1)]
    if 2 * bits + int(place) <= 64:  # pair and place in one number: sorting by value is the fastest
        packed = pair << place | at
        packed.sort()
        pair, at = packed >> place, (packed & ((np.uint64(1) << place) - np.uint64(1))).astype(np.uint32)
    else:
        order = np.argsort(pair, kind="stable")
        pair, at = pair[order], at[order]
    edge = np.concatenate([[0], np.flatnonzero(pair[1:] != pair[:-1]) + 1, [len(pair)]])
    n = np.diff(edge)
    often = n >= least
    return at[np.repeat(often, n)], np.repeat(np.arange(int(often.sum()), dtype=np.int32), n[often]), pair[edge[:-1][often]]


def _sizes(symbols: np.ndarray, first: int, length: np.ndarray) -> np.ndarray:
    """The number of ids that each symbol stands for."""
    out = np.ones(len(symbols), np.int64)
    rules = symbols >= first
    out[rules] = length[symbols[rules] - np.uint32(first)]
    return out


def compress(ids: np.ndarray, first: int, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, left, right, length) of the grammar of ids; all ids are below first. Every pair that stands least times, not overlapping, is replaced."""
    s = ids.astype(np.uint32)
    lefts, rights = [np.empty(0, np.uint32)], [np.empty(0, np.uint32)]
    length, top = np.empty(0, np.int64), first
    # Only places whose pair stood often enough in the last round, or is new, can have a pair to replace.
    at = np.arange(max(len(s) - 1, 0), dtype=np.uint32)
    while len(at):
        bits = int(top).bit_length()
        at, group, pairs = _grouped(s, at, bits, least)
        if not len(at):
            break
        left, right = (pairs >> np.uint64(bits)).astype(np.uint32), (pairs & np.uint64((1 << bits) - 1)).astype(np.uint32)
        twin = np.flatnonzero((left == right)[group])
        if len(twin):  # in a run of one symbol, every second place from its start
            p = at[twin]
            starts = np.append(True, (p[1:] != p[:-1] + np.uint32(1)) | (group[twin][1:] != group[twin][:-1]))
            begin = np.maximum.accumulate(np.where(starts, np.arange(len(p)), 0))
            stay = np.ones(len(at), bool)
            stay[twin[(np.arange(len(p)) - begin) % 2 == 1]] = False
            at, group = at[stay], group[stay]
        n = np.bincount(group, minlength=len(pairs))
        rank = np.empty(len(n), np.int32)
        rank[np.argsort(n, kind="stable")] = np.arange(1, len(n) + 1, dtype=np.int32)
        rank[n < least] = 0
        mine = rank[group]
        ranks = np.zeros(len(s) + 2, np.int32)  # by place + 1
        ranks[at + np.uint32(1)] = mine
        wins = (mine > ranks[at]) & (mine > ranks[at + np.uint32(2)])
        chosen = np.flatnonzero(np.bincount(group[wins], minlength=len(n)) >= least)
        if not len(chosen):
            break
        number = np.full(len(n), -1, np.int32)
        number[chosen] = np.arange(len(chosen), dtype=np.int32)
        wins &= number[group] >= 0
        where = at[wins]
        lefts.append(left[chosen])
        rights.append(right[chosen])
        length = np.append(length, _sizes(left[chosen], first, length) + _sizes(right[chosen], first, length))
        again = np.zeros(len(s), bool)
        again[at[mine > 0]] = True
        again[where] = True
        again[where[where > 0] - np.uint32(1)] = True
        s[where] = (top + number[group[wins]]).astype(np.uint32)
        keep = np.ones(len(s), bool)
        keep[where + np.uint32(1)] = False
        s = s[keep]
        at = np.flatnonzero(again[keep][:-1]).astype(np.uint32)
        top += len(chosen)
    return s, np.concatenate(lefts), np.concatenate(rights), length.astype(np.uint32)


def _unrolled(symbols: np.ndarray, first: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The ids of a few symbols, rule by rule, level by level."""
    s = symbols
    while len(s) and s.max() >= first:
        at = s >= first
        out = np.empty(len(s) + int(at.sum()), np.uint32)
        place = np.arange(len(s)) + np.cumsum(at) - at
        rule = s[at] - np.uint32(first)
        out[place[~at]] = s[~at]
        out[place[at]], out[place[at] + 1] = left[rule], right[rule]
        s = out
    return s


def expand(symbols: np.ndarray, first: int, left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The ids of a sequence of symbols: each rule is unrolled once, the sequence then gathered from all rules' ids."""
    if not len(length):
        return symbols
    if first + int(length.sum(dtype=np.int64)) > max(1 << 20, TABLE * len(symbols)):
        return _unrolled(symbols, first, left, right)
    table = np.concatenate([np.arange(first, dtype=np.uint32), _unrolled(np.arange(first, first + len(length), dtype=np.uint32), first, left, right)])
    begin = np.concatenate([np.arange(first), first + np.cumsum(length, dtype=np.int64) - length])
    n = _sizes(symbols, first, length)
    end = np.cumsum(n)
    return table[np.repeat(begin[symbols] - end + n, n) + np.arange(end[-1] if len(end) else 0)]


def read_ids(symbols: np.ndarray, first: int, left: np.ndarray, right: np.ndarray, length: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of a shard: only the symbols that cover them are expanded."""
    size = _sizes(symbols, first, length)
    end = np.cumsum(size)
    i, j = np.searchsorted(end, start, "right"), np.searchsorted(end, stop, "left") + 1
    base = end[i] - size[i] if i < len(end) else start
    return _unrolled(symbols[i:j], first, left, right)[start - base : stop - base]


_FORMAT = "part int, shard int, n_ids long, before long, doc_ids array<long>, ends array<long>, first int, left binary, right binary, length binary, symbols binary"


def encode(docs: DataFrame, vocabulary: str | Path) -> DataFrame:
    """The shards of docs (doc_id, text) in the file format above, to be written as Parquet.

    Null texts count as empty: they have the end id alone. Null doc_ids come first; rows that share a doc_id follow each
    other in the order of a hash of their texts, and may lie in different range partitions. An empty table has no shards.
    Other columns aren't carried.
    """
    spec = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(spec.value)
        first = c.tokenizer.get_vocab_size(with_added_tokens=True)
        part, shard, before = TaskContext.get().partitionId(), 0, 0
        names: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0
        end = np.array([END], np.uint32)

        def row() -> pa.RecordBatch:
            ends = np.cumsum([len(x) for x in held[::2]]) + np.arange(1, len(names) + 1)
            symbols, left, right, length = compress(np.concatenate(held), first)
            values = [[part], [shard], [size], [before], [names], [ends], [first], *([x.astype("<u4").tobytes()] for x in (left, right, length, symbols))]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names=["part", "shard", "n_ids", "before", "doc_ids", "ends", "first", "left", "right", "length", "symbols"])

        for some in slices_of_bytes(batches, "text", AT_ONCE):
            for name, ids in zip(some.column("doc_id").to_pylist(), c.encode(some.column("text")), strict=True):
                names.append(name)
                held += [ids, end]
                size += len(ids) + 1
                if size >= SHARD_IDS:
                    yield row()
                    before, shard = before + size, shard + 1
                    names, held, size = [], [], 0
        if held:
            yield row()

    ordered = docs.select("doc_id", F.xxhash64("text").alias("th"), "text").repartitionByRange("doc_id", "th").sortWithinPartitions("doc_id", "th").drop("th")
    return ordered.mapInArrow(run, _FORMAT)


def _placed(shards: DataFrame) -> DataFrame:
    """shards with base, the number of ids of all documents before them."""
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))  # as many rows as range partitions
    parts = parts.select(F.col("part").alias("p"), (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before_part"))
    return shards.join(F.broadcast(parts), F.col("part") == F.col("p")).withColumn("base", F.col("before") + F.col("before_part")).select("base", "doc_ids", "ends", "first", "left", "right", "length", "symbols")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, int]]:
    """(doc_ids, ids, ends, base) of each shard; one shard is in memory at a time, beside the batch that holds it."""
    for b in batches:
        for i in range(b.num_rows):
            left, right, length, symbols = (np.frombuffer(b.column(k)[i].as_buffer(), "<u4") for k in ("left", "right", "length", "symbols"))
            yield b.column("doc_ids")[i].values, expand(symbols, b.column("first")[i].as_py(), left, right, length), np.asarray(b.column("ends")[i].values), b.column("base")[i].as_py()


def decode(shards: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of every document in the shards; start is the number of ids of all documents before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, ids, ends, base in _read(batches):
            starts = np.append(0, ends[:-1])
            for k in range(0, len(ends), 1000):
                e, s = ends[k : k + 1000], starts[k : k + 1000]
                offsets = np.append(s[0], e) - s[0]
                yield pa.RecordBatch.from_arrays([names[k : k + 1000], pa.array(s + base), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids[s[0] : e[-1]].view(np.int32)))], names=["doc_id", "start", "ids"])

    return _placed(shards).mapInArrow(run, "doc_id long, start long, ids array<int>")


def digests(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the shards: the crc32 is that of its ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, ids, ends, base in _read(batches):
            starts, raw = np.append(0, ends[:-1]), memoryview(ids.astype("<u4", copy=False)).cast("B")
            crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([names, pa.array(starts + base), pa.array(ends - starts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _placed(shards).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
