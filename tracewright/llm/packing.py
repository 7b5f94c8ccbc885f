"""Best-fit packing of token sequences by hierarchical residuals.

1. Documents are encoded, closed with an end id and cut into pieces of at most CAPACITY ids.
2. Round 0: pieces are dealt in parts of about ITEMS; each part is packed by best fit, longest first. Bins that are full
   but for NEARLY ids are emitted; underfull ones go on as items of their own.
3. Parts are merged FAN by FAN like a tree, and the underfull bins of a merged part are packed by best fit again, until
   one part is left. A part hands on the emptiest ITEMS / FAN of its bins at most, those that can take or fill most, so a
   task of any round has about ITEMS items, whatever the corpus.

A bin holds at most CAPACITY pieces, so it can travel as one row. Every round is written; a lost task is done again from
the written bins.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import WORD, byte_letters
from .common import cut, slices_of_bytes

#: Ids of a sequence; the id that ends a document.
CAPACITY, END = 2048, 0
#: Items of a task, parts that are merged to one, free ids with which a bin is full enough to be emitted.
ITEMS, FAN, NEARLY = 1 << 17, 8, 8
#: Bytes of text that are encoded at a time.
AT_ONCE = 4 << 20
_LOADED: dict[str, Coder] = {}


class Coder:
    """The ids that the tokenizers library gives, from tiktoken where it gives the same ones, several times faster.

    That is so for a byte-level vocabulary with the usual pattern whose ids follow the order of its merges. Texts that
    tiktoken refuses (too long a run of white space), and all texts of other vocabularies, go to the library.
    """

    def __init__(self, spec: str):
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        said = json.loads(spec)
        pre, added = said.get("pre_tokenizer") or {}, said.get("added_tokens", [])
        plain = pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre.get("use_regex", True) and not said.get("normalizer") and not said["model"].get("dropout")
        self.fast = None
        if plain and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            vocab, special = said["model"]["vocab"], {t["content"]: t["id"] for t in added}
            merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in said["model"]["merges"]]
            if all(vocab[a + b] == 256 + i for i, (a, b) in enumerate(merges)):
                to_byte = {c: i for i, c in enumerate(byte_letters())}
                ranks = {bytes(to_byte[c] for c in t): i for t, i in vocab.items() if t not in special}
                self.fast = tiktoken.Encoding("own", pat_str=WORD.pattern, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> bytes:
        """The ids of a text, as little-endian unsigned 32-bit integers."""
        if self.fast:
            try:
                return np.array(self.fast.encode(text, allowed_special="all"), "<u4").tobytes()
            except (ValueError, RuntimeError):  # its pattern matcher gave up
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def coder(spec: str) -> Coder:
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Coder(spec)
    return _LOADED[key]


def pieces(docs: DataFrame, vocabulary: str | Path, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(uid, doc_id, piece, start, length, ids): the ids of every document and its end id, cut into pieces.

    ids are little-endian unsigned 32-bit integers. A document of more than capacity ids has full pieces, only the first
    one may be shorter. start counts the document's ids before the piece. uid numbers the pieces of the table that is
    written. Null texts count as empty ones: they have the end id alone. Other columns of docs aren't carried.
    """
    spec = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text())  # as large as a vocabulary, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, tail = coder(spec.value), np.array([end], "<u4").tobytes()
        uid = TaskContext.get().partitionId() << 33
        for b in slices_of_bytes(batches, "text", AT_ONCE):
            row, number, start, ids = [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                raw = c.encode(text or "") + tail
                n = len(raw) // 4
                at, k = 0, 0
                while at < n:
                    to = n - (n - at - 1) // capacity * capacity  # what follows is a multiple of capacity
                    row.append(i)
                    number.append(k)
                    start.append(at)
                    ids.append(raw[4 * at : 4 * to])
                    at, k = to, k + 1
            names = ["uid", "doc_id", "piece", "start", "length", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(uid, uid + len(row))), b.column("doc_id").take(pa.array(row)), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=names)
            uid += len(row)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"uid long, doc_id {kind}, piece int, start long, length long, ids binary")


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each item, free room of each bin): longest first, each into the open bin with the least room that suffices."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by free room
    some = 0  # bit r is set where rooms[r] has bins
    left: list[int] = []
    out = np.empty(len(sizes), np.int64)
    order = np.argsort(-sizes, kind="stable")
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = some >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            k = rooms[room].pop()
            if not rooms[room]:
                some &= ~(1 << room)
        else:
            k, room = len(left), capacity
            left.append(capacity)
        out[i] = k
        left[k] = room = room - size
        rooms[room].append(k)
        some |= 1 << room
    return out, np.array(left, np.int64)


_BINS = "size long, full boolean, items array<struct<uid:long,length:long,offset:long>>"


def _packed(capacity: int, nearly: int, most: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bins of one part, from bins that are its items: size and the pieces inside."""
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        sizes = np.concatenate([b.column("size").to_numpy() for b in held])
        items = pa.concat_arrays([b.column("items") for b in held])
        where, left = best_fit(sizes, capacity)
        order = np.argsort(where, kind="stable")  # a bin's items after each other, in the order of arrival
        count = np.bincount(where, pc.list_value_length(items).to_numpy(), minlength=len(left)).astype(np.int64)
        inside = items.take(pa.array(order)).flatten()
        edges = np.append(0, np.cumsum(count))
        uid, length = (pc.struct_field(inside, [c]) for c in (0, 1))
        upto = np.append(0, np.cumsum(length.to_numpy()))
        offset = upto[:-1] - np.repeat(upto[edges[:-1]], count)
        inside = pa.StructArray.from_arrays([uid, length, pa.array(offset)], ["uid", "length", "offset"])
        # the emptiest bins go on, as many as a merged part can take
        going = np.argsort(-left, kind="stable")[: 0 if last else most]
        full = np.ones(len(left), bool)
        full[going] = left[going] <= nearly
        for k in range(0, len(left), 1000):
            e = edges[k : k + 1001]
            lists = pa.ListArray.from_arrays(pa.array(e - e[0], pa.int32()), inside.slice(int(e[0]), int(e[-1] - e[0])))
            yield pa.RecordBatch.from_arrays([pa.array(capacity - left[k : k + 1000]), pa.array(full[k : k + 1000]), lists], names=["size", "full", "items"])

    return run


def pack(parts: DataFrame, capacity: int = CAPACITY, items: int = ITEMS, fan: int = FAN, nearly: int = NEARLY) -> DataFrame:
    """(uid, sequence_id, offset) for every row of parts (uid, length; 1 <= length <= capacity), whose uid are different.

    Each sequence has at most capacity ids, without gaps from 0. An empty table gives no rows.
    """
    parts = parts.select("uid", F.col("length").cast("long").alias("length"))
    one = F.array(F.struct("uid", "length", F.lit(0).cast("long").alias("offset")))
    bins = [cut(parts.where(F.col("length") >= capacity).select(F.col("length").alias("size"), F.lit(True).alias("full"), one.alias("items")), "bins")]
    going = parts.where(F.col("length") < capacity).select(F.col("length").alias("size"), F.lit(False).alias("full"), one.alias("items"))
    tasks = max(1, -(-going.count() // items))
    while True:
        run = _packed(capacity, nearly, items // fan, tasks == 1)
        # dealt in turn: each part gets items of all lengths, and no key decides
        bins.append(cut(going.repartition(tasks).mapInArrow(run, _BINS), "bins"))
        if tasks == 1:
            break
        going = bins[-1].where("NOT full")
        tasks = max(1, -(-tasks // fan))
    done = bins[0]
    for b in bins[1:]:
        done = done.union(b)
    # written, so that the numbers of sequences stay
    done = cut(done.where("full").select(F.monotonically_increasing_id().alias("sequence_id"), "items"), "sequences")
    return done.select("sequence_id", F.explode("items").alias("x")).select("x.uid", "sequence_id", "x.offset")


def placed(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """parts, a written table with uid and length, with sequence_id and offset instead of uid; other columns stay."""
    at = pack(parts, capacity).withColumnRenamed("uid", "p_uid")
    return parts.drop("sequence_id", "offset").join(at, F.col("uid") == F.col("p_uid")).drop("uid", "p_uid")


def sequences(rows: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the packed sequences of placed(), a row each; their size is bounded by the capacity."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    got = rows.groupBy("sequence_id").agg(F.sum("length").alias("length"), inside.alias("x"))
    return got.select("sequence_id", "length", F.expr("aggregate(x, cast('' AS binary), (a, p) -> concat(a, p.ids))").alias("ids"))
