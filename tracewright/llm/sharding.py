"""Sharding by vector bin packing: bytes, tokens and rows of each shard are balanced jointly.

What is packed are groups of equal texts. A group with a noticeable share of the corpus is an item of its own; all
others fall by hash into a fixed number of parcels, so the packing handles a bounded number of items at any corpus size.
Items go, largest first, to the shard where the dot product of item and residual capacity is highest among the shards
whose bytes suffice. A group with more bytes than a shard is cut into pieces, row by row, since no shard can hold it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut

SHARDS = 24
#: A group is an item of its own from 1 / (shards * OWN) of the bytes, tokens or rows; the rest share shards * PARCELS parcels.
OWN, PARCELS = 64, 512
#: Pieces per shard's worth of bytes that a group larger than a shard is cut into.
PIECES = 16
#: Cells by which places within a shard are counted; a window sees one cell of one shard.
CELLS = 1024


def profile(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, tokens, g): UTF-8 bytes of the text plus 8, unsigned crc32, words, and the key of equal texts."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.regexp_count(text, F.lit("\\S+")).cast("long").alias("tokens"), F.unhex(F.md5(F.encode(text, "UTF-8"))).alias("g"))


def pack(items: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item. items: bytes, tokens and rows of each, one row per item."""
    total = np.maximum(items.sum(0), 1)
    share = items / total
    left = np.full((shards, items.shape[1]), 1.0 / shards)
    out = np.empty(len(items), np.int32)
    for i in np.argsort(-share.max(1), kind="stable"):
        fit = left @ share[i]
        fit[left[:, 0] < share[i, 0]] = -np.inf
        best = int(np.argmax(fit))
        if fit[best] == -np.inf:
            best = int(np.argmax(left[:, 0]))
        out[i] = best
        left[best] -= share[i]
    return out


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, tokens) for every row of docs.

    law is 'bytes': the bytes of the shards come out near equal; so grown_shard is null. slot counts from 0 in each
    shard. Equal texts share a shard unless their bytes exceed one. Null texts count as empty ones, null doc_ids are
    allowed, repeated rows each get a slot, and an empty table gives no rows. Other columns of docs are not carried.
    """
    # a number for each row, whatever its doc_id: what hot groups are cut by; written, so that it stays
    rows = cut(profile(docs).withColumn("row", F.monotonically_increasing_id()), "profile")
    sums = [F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("r")]
    groups = cut(rows.groupBy("g").agg(*sums), "groups")
    b, t, r = (x or 0 for x in groups.agg(F.sum("b"), F.sum("t"), F.sum("r")).first())
    own = F.expr(f"b * {shards * OWN} >= {b} OR t * {shards * OWN} >= {max(t, 1)} OR r * {shards * OWN} >= {r}")
    parcel = F.pmod(F.xxhash64("g"), F.lit(shards * PARCELS)).cast("int")
    heavy = groups.where(own).withColumn("k", F.when(F.col("b") * shards > b, F.ceil(F.col("b") * shards * PIECES / max(b, 1))).otherwise(1).cast("int"))
    large = F.broadcast(heavy.where("k > 1").select(F.col("g").alias("large_g"), "k"))  # at most one per shard
    pieces = rows.join(large, rows.g == large.large_g).groupBy("g", F.pmod(F.xxhash64("row"), F.col("k")).alias("piece")).agg(*sums)

    wholes = [(bytes(x.g), 0, x.b, x.t, x.r) for x in heavy.where("k = 1").collect()]
    parts = [(bytes(x.g), int(x.piece), x.b, x.t, x.r) for x in pieces.collect()]
    rest = [(x.parcel, x.b, x.t, x.r) for x in groups.where(~own).groupBy(parcel.alias("parcel")).agg(F.sum("b").alias("b"), F.sum("t").alias("t"), F.sum("r").alias("r")).collect()]
    named = sorted(wholes + parts)
    rest.sort()
    chosen = pack(np.array([x[2:] for x in named] + [x[1:] for x in rest], np.float64).reshape(-1, 3), shards)
    by_group: dict[bytes, dict[int, int]] = {}
    for x, s in zip(named, chosen, strict=False):
        by_group.setdefault(x[0], {})[x[1]] = int(s)
    pieces_of = dict.fromkeys(by_group, 1) | {bytes(x.large_g): x.k for x in large.collect()}
    spark = docs.sparkSession
    of_group = spark.createDataFrame([(bytearray(g), [m.get(i, 0) for i in range(pieces_of[g])]) for g, m in by_group.items()], "own_g binary, own_shards array<int>")
    of_parcel = spark.createDataFrame([(x[0], int(s)) for x, s in zip(rest, chosen[len(named) :], strict=True)], "parcel int, parcel_shard int")
    # Both are bounded: 3 * shards * OWN groups, shards * (PIECES + 1) pieces, shards * PARCELS parcels.
    placed = rows.withColumn("parcel", parcel).join(F.broadcast(of_group), F.col("g") == F.col("own_g"), "left").join(F.broadcast(of_parcel), "parcel", "left")
    piece = F.expr("own_shards[cast(pmod(xxhash64(row), size(own_shards)) AS int)]")
    placed = placed.select("doc_id", "size", "text_crc32", "tokens", F.coalesce(piece, "parcel_shard").alias("shard"), "row", F.pmod(F.xxhash64("row"), F.lit(CELLS)).alias("cell"))
    placed = cut(placed, "placed")
    before = W.partitionBy("shard").orderBy("cell")
    cells = placed.groupBy("shard", "cell").agg(F.count("*").alias("n")).select(F.col("shard").alias("s"), F.col("cell").alias("c"), (F.sum("n").over(before) - F.col("n")).alias("before"))
    order = W.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "row")
    slots = placed.withColumn("at", F.row_number().over(order)).join(F.broadcast(cells), (F.col("shard") == F.col("s")) & (F.col("cell") == F.col("c")))
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("at") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "tokens")
