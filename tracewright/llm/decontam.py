"""Benchmark decontamination: size-partitioned MinHash containment search, with DataFrame functions only.

A short item inside a long document has a Jaccard similarity near 0, so a document's own minima would not show it. The
minima are therefore those of the item, its signature, and the document's shingles are probed for them (containment
MinHash). Items are partitioned by the size of their shingle set, in powers of 2; the signature of a partition has as many
minima as its largest size may miss, and SURE more. The share of the signature that a document holds estimates how much
of the item it contains. An item that is contained to the threshold lacks no more minima than it may miss shingles, so
documents with fewer can't hold it; all others are verified by the exact share of the item's shingles in the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

WORDS, PERCENT = 5, 80
#: Minima of a signature that an item held to the threshold can't lack, if it has so many shingles.
SURE = 4
#: Shingles of all items up to which they are broadcast (16 bytes each); a larger benchmark is joined by shuffles.
BROADCAST_SHINGLES = 500_000

_SHINGLES = """
  CASE WHEN size(words) >= {k}
    THEN array_distinct(transform(sequence(0, size(words) - {k}), i -> xxhash64({parts})))
    ELSE cast(array() AS array<bigint>) END
"""


def words(text: str = "text") -> Column:
    """Lower-cased runs of letters and digits; null counts as empty."""
    return F.expr(f"filter(split(regexp_replace(lower(coalesce({text}, '')), '[^\\\\p{{L}}\\\\p{{N}}]+', ' '), ' '), w -> w <> '')")


def shingle_hashes() -> Column:
    """Distinct hashes of the 5-word shingles of the column words; none for fewer words."""
    return F.expr(_SHINGLES.format(k=WORDS, parts=", ".join(f"words[i + {j}]" for j in range(WORDS))))


def item_shingles(benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(item_id, q, h, need, is_minimum) of items of five words or more; items that share an id are one item.

    need: the minima of its signature that a document must hold to be able to hold the item.
    """
    items = benchmark.where("item_id IS NOT NULL").select("item_id", words().alias("words")).select("item_id", F.explode(shingle_hashes()).alias("h")).distinct()
    sized = items.join(items.groupBy("item_id").agg(F.count("*").alias("q")), "item_id")
    ranked = sized.groupBy("item_id", "q").agg(F.sort_array(F.collect_list("h")).alias("hs"))  # as many as an item has
    largest = F.expr("2 * cast(pow(2, floor(log2(q))) AS bigint) - 1")  # of the item's size partition
    minima = F.least("q", F.floor(largest * (100 - percent) / 100) + SURE)
    need = F.greatest(F.lit(1), F.col("m") - F.floor(F.col("q") * (100 - percent) / 100))
    return ranked.select("item_id", "q", minima.alias("m"), F.posexplode("hs").alias("at", "h")).select("item_id", "q", "h", need.alias("need"), (F.col("at") < F.col("m")).alias("is_minimum"))


def contained(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, th, item_id, shared, item_shingles): items that a document holds, th being the hash of its text.

    Rows that agree in doc_id and text count once. Null, empty and short texts hold nothing; items of under five words
    are no evidence and are skipped. Empty tables give no rows.
    """
    items = cut(item_shingles(benchmark, percent), "items")
    small = items.count() <= BROADCAST_SHINGLES
    hint = F.broadcast if small else (lambda df: df)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    probe = keyed.select("doc_id", "th", words().alias("words")).select("doc_id", "th", F.explode(shingle_hashes()).alias("h"))
    minima = items.where("is_minimum").select("h", "item_id", "need")
    met = probe.join(hint(minima), "h").groupBy("doc_id", "th", "item_id", "need").agg(F.count("*").alias("hits"))
    found = met.where("hits >= need").groupBy("doc_id", "th").agg(F.collect_set("item_id").alias("items"))
    found = cut(found.select(F.col("doc_id").alias("found_id"), F.col("th").alias("found_th"), "items"), "candidates")
    same = keyed.doc_id.eqNullSafe(found.found_id) & (keyed.th == found.found_th)
    near = keyed.join(found, same).select("doc_id", "th", "items", "text").dropDuplicates(["doc_id", "th"])
    near = near.select("doc_id", "th", "items", words().alias("words")).select("doc_id", "th", "items", F.explode(shingle_hashes()).alias("h"))
    hits = near.join(hint(items.select("h", "item_id", "q")), "h").where("array_contains(items, item_id)")
    counted = hits.groupBy("doc_id", "th", "item_id", "q").agg(F.count("*").alias("shared"))
    return counted.where(f"100 * shared >= {percent} * q").select("doc_id", "th", "item_id", "shared", F.col("q").alias("item_shingles"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold a benchmark item. Columns stay; repeated rows go or stay together."""
    bad = contained(docs, benchmark).select(F.col("doc_id").alias("bad_id"), F.col("th").alias("bad_th")).distinct()
    return docs.join(bad, docs.doc_id.eqNullSafe(bad.bad_id) & (F.xxhash64(docs["text"]) == bad.bad_th), "left_anti")
