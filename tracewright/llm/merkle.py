"""Merkle manifest of a data set, with higher-order SQL functions over blocks.

A row's leaf is the sha256 of its fields. The leaves of each group (source), in the order of doc_id, are cut into arrays
of BLOCK nodes, a power of FAN: sequence, transform, slice and aggregate collapse such an array level by level to its
root, and since the array is whole, every level of it is also a level of the group's tree. Block roots are the nodes of
the next round, until each group has one: its subroot. Subroots, in the order of their groups, make a tree the same way.

Proofs are made on the way back: a node's proof is that inside its block, followed by the block's own. No group is ever
in one row or one task; a place in a group comes from range partitions and the counts before them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut

#: Nodes that are hashed together, and levels that a block collapses at a time.
FAN, LEVELS = 3, 6
BLOCK = FAN**LEVELS
#: The fields of a leaf, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_POWERS = f"transform(sequence(0, 39), k -> cast(pow({FAN}, k) AS decimal(20,0)))"
_STEPS = "array<struct<l:string,r:string>>"


def hashed(text: Column) -> Column:
    """H: lowercase hex of the sha256 of a text's UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def leaf(fields: list[Column]) -> Column:
    """The hash of a row's fields: each '-' if null, else its UTF-8 byte count, ':' and the value."""
    texts = [f.cast("string") for f in fields]
    return hashed(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)))


def _collapsed(levels: str) -> str:
    """SQL for all levels of the array of hashes named nodes, from itself up."""
    run = f"sha2(cast(array_join(slice(element_at(a, -1), i * {FAN} + 1, {FAN}), '') AS binary), 256)"
    return f"""aggregate(if({levels} > 0, sequence(1, {levels}), cast(array() AS array<int>)), array(nodes),
      (a, s) -> array_append(a, transform(sequence(0, cast((size(element_at(a, -1)) - 1) div {FAN} AS int)), i -> {run})))"""


def _steps(at: str) -> str:
    """SQL for the siblings of node `at` of a block on each level, those before it and those after it, as joined texts."""
    part = lambda of: f"array_join(slice(level, {of}), '')"
    q = f"(({at}) div cast(pow({FAN}, k) AS int))"
    left = part(f"{q} - {q} % {FAN} + 1, {q} % {FAN}")
    right = part(f"{q} + 2, {FAN} - 1 - {q} % {FAN}")
    return f"transform(slice(levels, 1, size(levels) - 1), (level, k) -> struct({left} AS l, {right} AS r))"


def positions(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows (written before) with pos, the place of each in its group by the given columns from 0, and n, the group's rows.

    Rows are sorted by ranges that split a group of any size; a row's place is that in its range and the rows of its
    group in the ranges before. Rows that agree in all columns may change places.
    """
    tie = F.xxhash64(F.monotonically_increasing_id())  # equal rows don't all go to one range
    ranged = rows.withColumn("tie", tie).repartitionByRange(group, *order, "tie").sortWithinPartitions(group, *order).drop("tie")
    ranged = cut(ranged.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ranged")
    cells = ranged.groupBy(group, "part").agg(F.min("at").alias("first"), F.count("*").alias("m"))
    before = W.partitionBy(group).orderBy("part")
    cells = cells.select(F.col(group).alias("cell_group"), F.col("part").alias("cell_part"), "first", (F.sum("m").over(before) - F.col("m")).alias("before"), F.sum("m").over(W.partitionBy(group)).alias("n"))
    joined = ranged.join(cells, (F.col(group) == F.col("cell_group")) & (F.col("part") == F.col("cell_part")))
    return joined.select(*rows.columns, (F.col("before") + F.col("at") - F.col("first")).alias("pos"), "n")


def _blocks(nodes: DataFrame, *more: str) -> DataFrame:
    """(g, block, n, items, root): nodes (g, pos, n, node and more columns) by blocks, in order, and each block's root."""
    item = F.struct("pos", "node", *more)
    blocks = nodes.groupBy("g", F.expr(f"pos div {BLOCK}").alias("block")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(item)).alias("items"))
    return blocks.withColumn("nodes", F.expr("transform(items, x -> x.node)")).withColumn("root", F.expr(f"element_at(element_at({_collapsed(_height())}, -1), 1)")).drop("nodes")


def _height() -> str:
    """SQL for the levels that a block of a group of n nodes collapses."""
    return f"least({LEVELS}, size(filter({_POWERS}, p -> p < n)))"


def _climb(nodes: DataFrame, *more: str) -> list[DataFrame]:
    """The blocks of every round, the first one's with more columns in their items, up to one block a group."""
    rounds = [cut(_blocks(nodes, *more), "blocks")]
    most = rounds[0].agg(F.max("n")).first()[0] or 0
    while most > BLOCK:
        up = rounds[-1].select("g", F.col("block").alias("pos"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"), F.col("root").alias("node"))
        rounds.append(cut(_blocks(up), "blocks"))
        most = -(-most // BLOCK)
    return rounds


def _descend(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """The items of the first round with steps, each node's whole proof, and root. above: (g, up, root) of each group."""
    up = above.select(F.col("g").alias("up_g"), F.lit(0).cast("long").alias("up_block"), "up", F.col("root").alias("top"))
    for k in range(len(rounds) - 1, -1, -1):
        own = rounds[k].join(up, (F.col("g") == F.col("up_g")) & (F.col("block") == F.col("up_block")))
        # levels is a lambda's variable, so that it is made once for all items
        each = f"transform(array({_collapsed(_height())}), levels -> transform(items, (x, at) -> struct(x, {_steps('at')} AS steps)))[0]"
        own = own.withColumn("nodes", F.expr("transform(items, x -> x.node)")).withColumn("each", F.expr(each))
        each = own.select("g", "up", "top", F.explode("each").alias("e")).select("g", "e.x", F.concat("e.steps", "up").alias("steps"), "top")
        if k:
            up = each.select(F.col("g").alias("up_g"), F.col("x.pos").alias("up_block"), F.col("steps").alias("up"), "top")
    return each.withColumnRenamed("top", "root")


def folded(node: Column, steps: Column) -> Column:
    """The root that a node and its proof give."""
    return F.aggregate(steps, node, lambda a, s: hashed(F.concat(s["l"], a, s["r"])))


def proof_text(steps: Column) -> Column:
    """The siblings of a proof, level by level, from left to right, as one text."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["l"], s["r"])), "")


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, subroot, root, steps, presented) for every row of docs (doc_id, source, lang, n_chars, text).

    steps is the row's proof: per level struct(l, r), the joined hashes of its siblings before and after it. presented is
    the leaf of the row after the tampering that audits test with: where 2 divides the crc32 of doc_id, the text has lost
    its line breaks. Leaves ascend by doc_id in each source, nulls first, ties by leaf; repeated rows are leaves of their
    own. A null source is a group of its own and comes first. An empty table gives no rows; other columns aren't carried.
    """
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    fields = [F.col(c) for c in FIELDS]
    # groups as texts without null, in the order of the sources
    g = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    leaves = cut(docs.select(g.alias("g"), "doc_id", leaf(fields).alias("node"), leaf([*fields[:-1], tampered]).alias("presented")), "leaves")
    rounds = _climb(positions(leaves, "g", "doc_id", "node"), "doc_id", "presented")
    subroots = rounds[-1].select(F.lit("all").alias("g"), F.col("g").alias("source"), F.col("root").alias("node"))
    tops = _climb(positions(cut(subroots, "subroots"), "g", "source"), "source")
    above = tops[-1].select("g", F.expr(f"cast(array() AS {_STEPS})").alias("up"), "root")
    by_source = cut(_descend(tops, above).select(F.col("x.source").alias("g"), F.col("steps").alias("up"), "root", F.col("x.node").alias("subroot")), "by_source")
    out = _descend(rounds, by_source.select("g", "up", F.struct("root", "subroot").alias("root")))
    return out.select("x.doc_id", F.when(F.col("g") != "", F.substring("g", 2, 1 << 30)).alias("source"), F.col("x.node").alias("leaf"), "root.subroot", "root.root", "steps", "x.presented")


def audit(rows: DataFrame) -> DataFrame:
    """manifest()'s rows with proof_sha256, folded_root (from the presented leaf and the stored proof) and verified."""
    out = rows.withColumn("proof_sha256", hashed(proof_text(F.col("steps")))).withColumn("folded_root", folded(F.col("presented"), F.col("steps")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
