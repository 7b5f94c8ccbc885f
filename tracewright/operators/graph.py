"""Graphs as node and edge tables: keys, upserts, deletions, closures, views and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.tables import cut, drop


def node_id(label: str, *key: str) -> Column:
    """A stable surrogate id made from a label and the natural key."""
    return F.sha2(F.concat_ws("\u0001", F.lit(label), *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key)), 256)


def nodes_view(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """(node_id, labels, props) of node tables given with their keys; props is JSON."""
    return reduce(DataFrame.unionByName, (df.select(node_id(label, *key).alias("node_id"), F.array(F.lit(label)).alias("labels"), F.to_json(F.struct("*")).alias("props")) for label, (df, key) in tables.items()))


def edges_view(edges: DataFrame) -> DataFrame:
    """(edge_id, src, dst, type, props) of an edge table with src, dst, type; the other columns become JSON."""
    rest = [c for c in edges.columns if c not in ("src", "dst", "type")]
    props = F.to_json(F.struct(*rest)) if rest else F.lit("{}")
    return edges.select(F.sha2(F.concat_ws("\u0001", "src", "dst", "type", props), 256).alias("edge_id"), "src", "dst", "type", props.alias("props"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: dict[str, Column] | None = None) -> DataFrame:
    """old with the rows of new put in by key: new values win unless null. keep: columns with their own rule.

    Rules see old values as o_<name> and new ones as n_<name>. Of rows of new that share a key the last in the order of
    all columns holds, so the result does not depend on partitions.
    """
    rest = [c for c in old.columns if c not in keys]
    w = W.partitionBy(*keys).orderBy(*(F.desc_nulls_last(c) for c in rest if c in new.columns))
    last = new.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    o = old.select(*keys, *(F.col(c).alias(f"o_{c}") for c in rest), F.lit(True).alias("_o"))
    n = last.select(*keys, *((F.col(c) if c in new.columns else F.lit(None).cast(old.schema[c].dataType)).alias(f"n_{c}") for c in rest))
    keep = keep or {}
    return o.join(n, keys, "full").select(*keys, *(keep.get(c, F.coalesce(f"n_{c}", f"o_{c}")).alias(c) for c in rest))


def fill_blank(name: str) -> Column:
    """A rule for upsert(): a blank old value takes the new one, any other stays."""
    return F.when(F.coalesce(F.trim(f"o_{name}"), F.lit("")).isin("", "N/A"), F.coalesce(f"n_{name}", f"o_{name}")).otherwise(F.col(f"o_{name}"))


def source_priority(name: str = "source", first: str = "ddl") -> Column:
    """A rule for upsert(): a value from the definition is never replaced."""
    return F.when(F.col(f"o_{name}") == first, F.col(f"o_{name}")).otherwise(F.coalesce(f"n_{name}", f"o_{name}"))


def create_missing(old: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """old and a row for each wanted key that it lacks."""
    return old.unionByName(wanted.select(*keys).distinct().join(old, keys, "left_anti"), allowMissingColumns=True)


def delete_edges(edges: DataFrame, gone: Column) -> tuple[DataFrame, DataFrame]:
    """(edges left, one row with the number deleted)."""
    at = F.coalesce(gone, F.lit(False))
    return edges.where(~at), edges.agg(F.count_if(at).alias("deleted"))


def detach_delete(nodes: DataFrame, edges: DataFrame, gone: Column, key: str = "node_id") -> tuple[DataFrame, DataFrame]:
    """nodes without the gone ones, and edges without those that touch them."""
    dead = nodes.where(gone).select(F.col(key).alias("_dead")).distinct()
    left = edges.join(dead, F.col("src") == F.col("_dead"), "left_anti").join(dead, F.col("dst") == F.col("_dead"), "left_anti")
    return nodes.where(~F.coalesce(gone, F.lit(False))), left


def is_unique(df: DataFrame, keys: list[str]) -> bool:
    return df.groupBy(*keys).count().where("count > 1").isEmpty()


def closure(edges: DataFrame, cycles: bool = False) -> DataFrame:
    """(src, dst, distance) of all pairs that a path links, with the shortest distance. edges: src, dst.

    Distances double: a pair at 2^k + d steps is one at 2^k and one at d of 2^k steps or fewer, so the rounds grow with the
    logarithm of the longest path. Rounds are written to the shared folder and don't grow the lineage. Without cycles
    (said of the edges) a pair of a node with itself is an error, since it would go on for ever in a tree's rounds.
    """
    step = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    every, span = [cut(step.withColumn("distance", F.lit(1)), "closure")], 1
    while True:
        known = reduce(DataFrame.unionByName, every)
        far = every[-1].where(F.col("distance") == span).select("src", F.col("dst").alias("_via"))
        far = far.join(known.select(F.col("src").alias("_via"), "dst", (F.col("distance") + span).alias("distance")), "_via")
        far = far.groupBy("src", "dst").agg(F.min("distance").alias("distance")).join(known.select("src", "dst"), ["src", "dst"], "left_anti")
        new = cut(far, "closure")
        n, loops = new.agg(F.count("*"), F.count_if(F.col("src") == F.col("dst"))).first()
        if loops and not cycles:
            raise ValueError("the edges have a cycle")
        if not n:
            drop(new)
            return known
        every.append(new)
        span *= 2


def _jumps(edges: DataFrame, child: str = "dst", parent: str = "src") -> DataFrame:
    return edges.select(F.col(child).alias("node"), F.col(parent).alias("up")).where("node IS NOT NULL AND up IS NOT NULL AND node <> up").distinct()


def depths(nodes: DataFrame, edges: DataFrame, key: str = "node_id") -> DataFrame:
    """nodes with depth: the number of ancestors of each in a tree of edges (src parent, dst child).

    Each node points to its parent, then to its parent's parent, and so on, twice as far each round; there are as many
    rows as nodes, never pairs. Of several parents the least counts; a node in or below a cycle is an error.
    """
    at = cut(_jumps(edges).groupBy("node").agg(F.min("up").alias("up")).withColumn("d", F.lit(1)), "depth")
    rounds = max(at.count(), 1).bit_length() + 1
    while not at.where("up IS NOT NULL").isEmpty():
        if not rounds:
            raise ValueError("the edges have a cycle")
        above = at.select(F.col("node").alias("_n"), F.col("up").alias("_u"), F.col("d").alias("_d"))
        at = cut(at.join(above, F.col("up") == F.col("_n"), "left").select("node", F.col("_u").alias("up"), (F.col("d") + F.coalesce("_d", F.lit(0))).alias("d")), "depth", after=at)
        rounds -= 1
    return nodes.join(at.select(F.col("node").alias("_n"), F.col("d").alias("_d")), F.col(key) == F.col("_n"), "left").withColumn("depth", F.coalesce("_d", F.lit(0))).drop("_n", "_d")


def heights(nodes: DataFrame, edges: DataFrame, key: str = "node_id") -> DataFrame:
    """nodes with height: the longest way from each down to a node without children, in a tree of edges (src parent, dst child).

    What stands 2^k below a node tells it the height that it has found so far, then what stands 2^(k+1) below; there are
    as many rows as nodes, never pairs. Of several parents the least counts; a node in or below a cycle is an error.
    """
    jump = cut(_jumps(edges).groupBy("node").agg(F.min("up").alias("up")), "jump")
    high, span = cut(nodes.select(F.col(key).alias("node")).where("node IS NOT NULL").distinct().withColumn("h", F.lit(0)), "height"), 1
    rounds = max(jump.count(), 1).bit_length() + 1
    while not jump.isEmpty():
        if not rounds:
            raise ValueError("the edges have a cycle")
        told = jump.join(high.select(F.col("node").alias("_n"), "h"), F.col("node") == F.col("_n")).groupBy("up").agg((F.max("h") + span).alias("_h"))
        high = cut(high.join(told, F.col("node") == F.col("up"), "left").select("node", F.greatest("h", F.coalesce("_h", F.lit(0))).alias("h")), "height", after=high)
        jump = cut(jump.join(jump.select(F.col("node").alias("_m"), F.col("up").alias("_u")), F.col("up") == F.col("_m")).select("node", F.col("_u").alias("up")), "jump", after=jump)
        span, rounds = 2 * span, rounds - 1
    return nodes.join(high.select(F.col("node").alias("_n"), F.col("h").alias("height")), F.col(key) == F.col("_n"), "left").drop("_n")


def gather_up(facts: DataFrame, edges: DataFrame, key: str = "node_id") -> DataFrame:
    """The different facts (key and other columns) of each node and of all nodes below it. edges: src (above), dst (below).

    Facts climb one step, then two more, then four: those gathered so far are joined each round with a table of who stands
    so far above whom. That has a row for each node in a tree. Nodes may have several parents, and in a cycle all have the
    facts of all, but then the table holds all pairs at such a distance, the square of the nodes in a dense graph.
    """
    held, jump = cut(facts.distinct(), "facts"), cut(_jumps(edges), "jump")
    rounds = max(jump.count(), 1).bit_length()
    while rounds and not jump.isEmpty():
        up = held.join(jump, held[key] == jump.node).select(*(F.col("up").alias(key) if c == key else held[c] for c in facts.columns))
        held = cut(held.union(up).distinct(), "facts", after=held)
        twice = jump.select("node", F.col("up").alias("_m")).join(jump.select(F.col("node").alias("_m"), "up"), "_m").select("node", "up").distinct()
        jump = cut(twice, "jump", after=jump)
        rounds -= 1
    return held


def reached(edges: DataFrame, start: DataFrame, key: str = "node_id", up: bool = True) -> DataFrame:
    """(start, node): what stands above each of the start nodes, or below. edges: src (above), dst (below), of a tree.

    Only what is asked for is walked: pairs begin with the start nodes and reach twice as far each round, over a table of
    who stands so far above whom, which has a row for each node. Of a node with several parents all are followed.
    """
    own = start.select(F.col(key).alias("start")).where("start IS NOT NULL").distinct()
    found, jump = cut(own.withColumn("node", F.col("start")), "reached"), cut(_jumps(edges), "jump")
    rounds = max(jump.count(), 1).bit_length() + 1
    a, b = ("node", "up") if up else ("up", "node")
    while rounds and not jump.isEmpty():
        step = jump.select(F.col(a).alias("_a"), F.col(b).alias("_b"))
        far = found.join(step, F.col("node") == F.col("_a")).select("start", F.col("_b").alias("node"))
        found = cut(found.union(far).distinct(), "reached", after=found)
        jump = cut(jump.select("node", F.col("up").alias("_m")).join(jump.select(F.col("node").alias("_m"), "up"), "_m").select("node", "up").distinct(), "jump", after=jump)
        rounds -= 1
    return found.where("start <> node")


def nearest(edges: DataFrame, marked: DataFrame, key: str = "node_id") -> DataFrame:
    """(node, up): the nearest marked node above each node of a tree that has one. edges: src (above), dst (below).

    Each node points to its parent, then past it as long as what it points to isn't marked, twice as far each round.
    """
    known = marked.select(F.col(key).alias("_m")).distinct()
    least = _jumps(edges).groupBy("node").agg(F.min("up").alias("up"))
    at = cut(least.join(known, F.col("up") == F.col("_m"), "left").select("node", "up", F.col("_m").isNotNull().alias("there")), "nearest")
    rounds = max(at.count(), 1).bit_length() + 1
    while not at.where("NOT there").isEmpty():
        if not rounds:
            raise ValueError("the edges have a cycle")
        above = at.select(F.col("node").alias("_n"), F.col("up").alias("_u"), F.col("there").alias("_t"))
        past = at.where("NOT there").join(above, F.col("up") == F.col("_n")).select("node", F.col("_u").alias("up"), F.col("_t").alias("there"))
        at = cut(at.where("there").union(past), "nearest", after=at)
        rounds -= 1
    return at.select("node", "up")


def within(links: DataFrame, costs: DataFrame, limit: int) -> DataFrame:
    """(node, up, distance, total): what each node reaches by its links (node, up: one each) while the sum of costs fits the limit.

    costs: node, cost (0 or more) of each node that is reached. Nothing beyond a limit is looked at: pairs reach twice as
    far each round, from the farthest that a node could still pay for.
    """
    priced = costs.select(F.col("node").alias("_c"), F.col("cost").cast("long").alias("total"))
    step = links.join(priced, F.col("up") == F.col("_c")).where(F.col("total") <= limit).select("node", "up", F.lit(1).alias("distance"), "total")
    every, span = [cut(step, "within")], 1
    while True:
        known = reduce(DataFrame.unionByName, every)
        far = every[-1].where(F.col("distance") == span).select("node", F.col("up").alias("_via"), F.col("total").alias("_t"))
        on = known.select(F.col("node").alias("_via"), "up", (F.col("distance") + span).alias("distance"), F.col("total").alias("_on"))
        new = cut(far.join(on, "_via").select("node", "up", "distance", (F.col("_t") + F.col("_on")).alias("total")).where(F.col("total") <= limit), "within")
        if new.isEmpty():
            drop(new)
            return known
        every.append(new)
        span *= 2


def all_descendants_ok(nodes: DataFrame, edges: DataFrame, key: str = "node_id") -> DataFrame:
    """nodes (with ok) with subtree_ok: false as soon as the node or anything below it failed; a null ok has failed."""
    failed = nodes.where(~F.coalesce("ok", F.lit(False))).select(F.col(key).alias("_bad")).where("_bad IS NOT NULL")
    bad = gather_up(failed, edges, "_bad")
    return nodes.join(bad, F.col(key) == F.col("_bad"), "left").withColumn("subtree_ok", F.col("_bad").isNull()).drop("_bad")


def next_edges(nodes: DataFrame, group: list[str], order: list[str], key: str = "node_id", stop: Column | None = None) -> DataFrame:
    """(src, dst) of neighbours in each group; stop: nodes after which the chain breaks."""
    w = W.partitionBy(*group).orderBy(*order)
    out = nodes.select("*", F.lead(key).over(w).alias("_next")).where(F.col("_next").isNotNull())
    if stop is not None:
        out = out.where(~stop)
    return out.select(F.col(key).alias("src"), F.col("_next").alias("dst"))


def histogram(df: DataFrame, label: str, every: bool = False) -> DataFrame:
    """(label, n): rows by their first label, or by each of their labels."""
    c = F.col(label)
    if df.schema[label].dataType.typeName() == "array":
        c = F.explode(c) if every else F.get(c, F.lit(0))
    return df.select(c.alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def foreign_related(fks: DataFrame, table: str) -> DataFrame:
    """(other, direction, pairs, source) of tables linked to one by foreign keys: column pairs gathered, the least source kept."""
    out = fks.where((F.col("from_table") == table) | (F.col("to_table") == table))
    other = F.when(F.col("from_table") == table, F.col("to_table")).otherwise(F.col("from_table"))
    direction = F.when(F.col("from_table") == table, "out").otherwise("in")
    pairs = F.array_join(F.sort_array(F.collect_set(F.concat("from_column", F.lit("="), "to_column"))), ",")
    return out.groupBy(other.alias("other"), direction.alias("direction")).agg(pairs.alias("pairs"), F.min("source").alias("source"))


def co_referenced(uses: DataFrame, table: str, by: str = "unit", name: str = "table_name") -> DataFrame:
    """(other, n_units): tables that the units using a table use as well. uses: a row per unit and table."""
    pairs = uses.select(by, name).distinct()
    units = pairs.where(F.col(name) == table).select(by)
    return pairs.join(units, by, "left_semi").where(F.col(name) != table).groupBy(F.col(name).alias("other")).agg(F.count("*").alias("n_units"))


def related(fks: DataFrame, uses: DataFrame, table: str) -> DataFrame:
    """(other, kind): tables related by foreign key first, then those only co-referenced."""
    fk = foreign_related(fks, table).select("other").distinct().withColumn("kind", F.lit("FK"))
    co = co_referenced(uses, table).select("other").join(fk, "other", "left_anti").withColumn("kind", F.lit("CO_REFERENCED"))
    return fk.unionByName(co)


def importance(fks: DataFrame) -> DataFrame:
    """(table_name, n_out, n_in, importance): log(1 + 2 * incoming + outgoing) of each table."""
    ends = fks.select(F.col("from_table").alias("table_name"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(fks.select("to_table", F.lit(0), F.lit(1)))
    return ends.groupBy("table_name").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in")).withColumn("importance", F.log1p(2 * F.col("n_in") + F.col("n_out")))
