"""N-gram Jaccard join of documents: a size-aware heavy-light join (after Deng, Tao and Li, 2018), on sets of word shingles.

Documents link if 100 * |A & B| >= 80 * |A | B| for their sets of 5-word shingles. Steps:

1. One row per different set (exact copies meet by a hash of the set), with the LEAST smallest shingle hashes.
2. Sieve: of two linked sets, each has more than a quarter of its least hashes among the other's (all but certain: for 32
   hashes the chance of missing a linked pair is under 3e-12, far below that of a clash of 64-bit hashes in a large
   corpus; for sets of up to 32 shingles it is certain). Sets without that go no further, so whole sets are only
   gathered where a partner can exist.
3. Light sets, up to a size taken from the cost of both ways, enumerate their subsets of the size that two linked
   sets must share; an equal subset is a link.
4. Heavy sets scan inverted lists of the rare ends of the sets (prefix filter: rarest shared shingles first), against
   light and heavy ones. Each list pairs its members with its leader instead of all with all; the pairs are verified
   on the whole sets. Only pairs of a list that are not yet in one component are formed in a second pass, and of these
   only those whose sizes the place of the shingle in both prefixes allows: a member meets the range of sizes that it can
   link with, so many texts that share a frame, each with too much of its own, are not paired at all.
5. Connected components give the class of each document.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, slices

WORDS, PERCENT = 5, 80
LEAST = 32
#: Sizes within this factor share a bucket in which partners of a size are looked for.
STEP = 1.05
#: Orders of documents by which the leaders of different inverted lists are chosen where several are equally good.
LEADERS = 4
CACHE = 1 << 17
_WORD = re.compile(r"[^ \t\n\x0b\f\r]+")
_UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def word_hashes(text: str | None, known: dict[str, int]) -> np.ndarray:
    """64-bit hashes of the words of a text, A-Z lower-cased. known: a cache of bounded size."""
    words = _WORD.findall((text or "").translate(_UPPER) if text and not text.isascii() else (text or "").lower())
    if len(known) > CACHE:
        known.clear()
    out = [known.get(w) for w in words]
    if None in out:
        for i, h in enumerate(out):
            if h is None:
                out[i] = known[words[i]] = xxhash.xxh3_64_intdigest(words[i])
    return np.array(out, np.uint64)


def shingles(text: str | None, known: dict[str, int]) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; fewer words make one shingle; none make none."""
    h = word_hashes(text, known)
    if not len(h):
        return h
    with np.errstate(over="ignore"):
        if len(h) < WORDS:
            mixed = np.array([xxhash.xxh3_64_intdigest(h.tobytes())], np.uint64)
        else:
            mixed = sum((h[k : len(h) - WORDS + 1 + k] * _MIX[k] for k in range(1, WORDS)), h[: len(h) - WORDS + 1] * _MIX[0])
            mixed ^= mixed >> np.uint64(32)
            mixed *= np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(29)
    mixed = np.sort(mixed)
    return mixed[np.append(True, mixed[1:] != mixed[:-1])].view(np.int64)


def needed(a: int, b: int, percent: int = PERCENT) -> int:
    """Shingles that linked sets of these sizes share at least."""
    return -(-percent * (a + b) // (100 + percent))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, int] = {}
    for b in slices(batches):
        rows = [shingles(t, known) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array([len(x) for x in rows], pa.int64()), pa.array([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in rows], pa.binary()), pa.array([x[:LEAST] for x in rows], pa.list_(pa.int64()))],
            names=["doc_id", "n_shingles", "set_hash", "least"],
        )


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, int] = {}
    for b in slices(batches):
        rows = [shingles(t, known) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) for x in rows], pa.int64()), pa.array(rows, pa.list_(pa.int64()))], names=["doc", "n", "shingles"])


def subset_keys(a: int, shingle: list[int], most: int, percent: int = PERCENT) -> Iterator[tuple[int, int, bytes]]:
    """(smaller size, larger size, hash of a subset) for each subset that a light partner may share with a set of a shingles."""
    for b in range(1, most + 1):
        low, high = min(a, b), max(a, b)
        if 100 * low >= percent * high:
            for chosen in combinations(shingle, needed(low, high, percent)):
                yield low, high, xxhash.xxh3_128_digest(np.array(chosen, np.int64).tobytes())


def enumerated(size: int, most: int) -> int:
    """Subsets that a set of so many shingles enumerates if sets of up to `most` are light."""
    return sum(comb(size, needed(min(size, b), max(size, b))) for b in range(1, most + 1) if 100 * min(size, b) >= PERCENT * max(size, b))


def light_size(sizes: list[tuple[int, int, int]]) -> int:
    """The largest size whose sets are cheaper to enumerate than to scan for. sizes: (size, sets, entries of the lists their prefixes read)."""
    best, total = 0, sum(read for _, _, read in sizes)
    best_cost, x = total, 0
    # What one set enumerates only grows with its size: beyond what all scans read, no larger boundary pays.
    while enumerated(x + 1, x + 1) <= total:
        x += 1
        cost = sum(n * enumerated(size, x) if size <= x else read for size, n, read in sizes)
        if cost < best_cost:
            best, best_cost = x, cost
    return best


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose whole sets are similar enough. Only shared shingles are stored; n counts all."""
    left = sets.select(F.col("doc").alias("u"), F.col("n").alias("n_u"), F.col("shared").alias("s_u"))
    right = sets.select(F.col("doc").alias("v"), F.col("n").alias("n_v"), F.col("shared").alias("s_v"))
    both = pairs.join(left, "u").join(right, "v").withColumn("o", F.size(F.array_intersect("s_u", "s_v")))
    return both.where(f"100 * o >= {PERCENT} * (n_u + n_v - o)").select("u", "v")


def _light_links(sets: DataFrame, light: int) -> DataFrame:
    """Links between sets of up to `light` shingles. Members of a key are all linked if both sizes are there; the least stands for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, low, high, len(s) == low, len(s) == high, k) for d, s in zip(b.column("doc").to_pylist(), b.column("shingles").to_pylist(), strict=True) for low, high, k in subset_keys(len(s), s, light)]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary()), strict=True)], names=["doc", "low", "high", "is_low", "is_high", "k"])

    keys = sets.where(F.col("n") <= light).select("doc", "shingles").mapInArrow(run, "doc long, low int, high int, is_low boolean, is_high boolean, k binary")
    keys = cut(keys, "subsets")
    both = keys.groupBy("low", "high", "k").agg(F.min("doc").alias("u"), F.count("*").alias("c"), F.max("is_low").alias("l"), F.max("is_high").alias("h")).where("c > 1 AND l AND h").select("low", "high", "k", "u")
    return keys.join(both, ["low", "high", "k"]).where("doc <> u").select("u", F.col("doc").alias("v")).distinct()


def linked_sets(sets: DataFrame) -> DataFrame:
    """(node, component) of the linked sets. sets: doc, n, shingles (sorted hashes), one row per different set."""
    entries = sets.select("doc", "n", F.explode("shingles").alias("h"))
    held = entries.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    # A set's unique shingles come first in the order of rarity; the rest of its prefix are its rarest shared ones.
    shared = entries.join(held, "h").groupBy("doc", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("x"))
    shared = shared.withColumn("p", F.expr(f"n - cast(ceil(n * {PERCENT} / 100.0) AS bigint) + 1 - (n - size(x))")).where("p > 0")
    kept = cut(shared.select("doc", "n", "p", F.col("x.h").alias("shared"), F.slice("x", 1, F.col("p").cast("int")).alias("ends")), "shared")

    # a row for each size of set
    sizes = kept.groupBy("n").agg(F.count("*").alias("sets"), F.sum(F.expr("aggregate(ends, 0L, (a, e) -> a + e.df)")).alias("read")).collect()
    light = light_size([tuple(r) for r in sizes])
    small = sets.where(F.col("n") <= light).join(kept.where(F.col("n") <= light).select("doc"), "doc", "left_semi")
    links = cut(_light_links(small, light), "light") if light else None

    alone = (F.col("n") - F.size("shared")).alias("alone")
    lists = kept.select("doc", "n", alone, F.posexplode("ends").alias("at", "e")).select("doc", "n", "alone", "e.h", (F.col("alone") + F.col("at")).alias("place"))
    lists = cut(lists, "lists")
    sized = f"100 * least(n_u, n_v) >= {PERCENT} * greatest(n_u, n_v) AND greatest(n_u, n_v) > {light}"
    # What follows the two places bounds the overlap, for the first shingle that both prefixes hold.
    sized += f" AND least(n_u - p_u, n_v - p_v) >= {PERCENT} * (n_u + n_v) / {100 + PERCENT}.0 - 1e-9"
    # The member with the fewest shingles of its own lies nearest to all others: copies of one text link to it if to any.
    member = lists.select("h", F.pmod(F.xxhash64("h"), F.lit(LEADERS)).alias("turn"), "doc", "n", "alone", "place")
    lead = member.groupBy("h").agg(F.min(F.struct("alone", F.xxhash64("doc", "turn").alias("o"), "doc", "n", "place")).alias("lead"), F.count("*").alias("c")).where("c > 1").select("h", "lead")
    pairs = member.join(lead, "h").where("doc <> lead.doc").select(F.least("doc", "lead.doc").alias("u"), F.greatest("doc", "lead.doc").alias("v"), F.col("n").alias("n_u"), F.col("lead.n").alias("n_v"), F.col("place").alias("p_u"), F.col("lead.place").alias("p_v"))
    first = cut(_verified(pairs.where(sized).select("u", "v").distinct(), kept), "links")
    links = links.union(first) if links is not None else first
    found = components(links, "u", "v")

    named = lists.join(found, lists.doc == found.node, "left").select("h", "doc", "n", "place", F.coalesce("component", "doc").alias("c"))
    split = named.groupBy("h").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("h")
    rest = cut(named.join(split, "h"), "rest")
    # u is the larger one; place p of n leaves room for partners of up to most(n, p) shingles
    most = F.floor(F.lit(1 + 100 / PERCENT) * (F.col("n") - F.col("place")) - F.col("n") + 1e-6)
    bucket = lambda n: F.floor(F.log(n) / math.log(STEP)).cast("int")
    a = rest.withColumns({"low": F.ceil(F.col("n") * PERCENT / 100.0), "high": F.least("n", most)}).where("low <= high")
    a = a.select("h", F.col("doc").alias("u"), F.col("n").alias("n_u"), F.col("place").alias("p_u"), F.col("c").alias("c_u"), F.explode(F.sequence(bucket(F.col("low")), bucket(F.col("high")))).alias("b"))
    b = rest.select("h", F.col("doc").alias("v"), F.col("n").alias("n_v"), F.col("place").alias("p_v"), F.col("c").alias("c_v"), bucket(F.col("n")).alias("b"))
    more = a.join(b, ["h", "b"]).where("c_u <> c_v AND (n_v < n_u OR n_v = n_u AND v < u)").where(sized).select("u", "v").distinct()
    links = links.union(cut(_verified(more, kept), "links"))
    return components(links, "u", "v")


def classes(docs: DataFrame, sieve: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text).

    sieve: step 2. Without it every set is gathered whole and no link can be missed, at a higher cost.

    component_id is the least doc_id reachable by links, the row's own included; null and wordless texts link with
    nothing. doc_id is a key: repeated rows are one document, each with its row in the result; of different texts under
    one doc_id, which is no key then, only the least is compared in near (not equal) pairs. A row with a null doc_id gets
    the class of the documents that have its set, else null. Other columns of docs are not carried.
    """
    profile = cut(docs.select("doc_id", "text").mapInArrow(_sets, "doc_id long, n_shingles long, set_hash binary, least array<long>"), "profiles")
    sets = profile.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_hash").agg(F.min("doc_id").alias("doc"), F.min("n_shingles").alias("n"), F.count("*").alias("copies"))
    one = profile.select(F.col("doc_id").alias("doc"), F.col("set_hash").alias("sh"), "least")
    keys = cut(sets.join(one, (sets.doc == one.doc) & (sets.set_hash == one.sh)).select(sets.doc, "set_hash", "n", "least").dropDuplicates(["set_hash"]), "sets")

    enough = keys.select("doc", "n")
    if sieve:
        marks = keys.select("doc", "n", F.explode("least").alias("h"))
        met = marks.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
        enough = marks.join(met, "h").groupBy("doc", "n").agg(F.count("*").alias("m")).where(f"4 * m >= least(n, {LEAST})").select("doc", "n")
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    texts = texts.join(enough, texts.doc_id == enough.doc, "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    found = linked_sets(cut(texts.mapInArrow(_whole_sets, "doc long, n long, shingles array<long>"), "whole"))

    named = keys.join(found, keys.doc == found.node, "left").select("set_hash", F.coalesce("component", keys.doc).alias("component_id"))
    out = profile.select("doc_id", "n_shingles", "set_hash").join(named.withColumnRenamed("set_hash", "sh"), F.col("set_hash") == F.col("sh"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
