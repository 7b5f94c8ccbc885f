"""Graphs on disk: node and edge tables as Parquet.

write_graph() replaces a whole graph, a folder for each label and type. Store keeps one up to date: rows are dealt into
partitions by label (or type) and a hash of their id, and a merge rewrites only the partitions that its rows fall into.
What is current is said by a manifest, a small file that names the folder of each partition. A merge writes its
partitions beside the old ones and then the next manifest, by a rename that fails if there is one already: readers see
the graph before or after a merge, never half of it, and of two merges at once one is told to start again.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .tables import children, cut, delete, exists, read_text, write_new


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Writes nodes_view() and edges_view() rows, each id once; a reader of one label reads that label's files alone."""
    nodes.dropDuplicates(["node_id"]).withColumn("label", F.get("labels", F.lit(0))).write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
    edges.dropDuplicates(["edge_id"]).write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes").drop("label"), spark.read.parquet(f"{path}/edges")


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n): nodes by first label and edges by type."""
    n = nodes.groupBy(F.lit("node").alias("kind"), F.get("labels", F.lit(0)).alias("name")).agg(F.count("*").alias("n"))
    return n.unionByName(edges.groupBy(F.lit("edge").alias("kind"), F.col("type").alias("name")).agg(F.count("*").alias("n")))


NODES = "node_id string, labels array<string>, props string"
EDGES = "edge_id string, src string, dst string, type string, props string"
#: Of a unique key: who holds it.
KEYS = "label string, key_hash string, node_id string"
REJECTED = "node_id string, labels array<string>, props string, holder string, version int"

#: Partitions of each label and type.
BUCKETS = 16


class Conflict(Exception):
    """Another merge was committed first."""


@dataclass
class Merge:
    """What a merge did: the version it made, the touched part of the graph as it is now, and the rows it turned away."""

    version: int
    nodes: DataFrame
    edges: DataFrame
    rejected: DataFrame
    rewritten: list[tuple[str, str]] = field(default_factory=list)


class Store:
    """A graph in a folder. unique: for a label the properties that no two of its nodes may share (a null one is not compared)."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, unique: dict[str, list[str]] | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        first = self._manifest(0)
        if first is None:
            write_new(spark, f"{self.path}/manifest/0.json", json.dumps({"buckets": buckets, "unique": unique or {}, "parts": {}}))
            first = self._manifest(0)
        self.buckets, self.unique = first["buckets"], first["unique"]

    def _manifest(self, version: int) -> dict | None:
        at = f"{self.path}/manifest/{version}.json"
        return json.loads(read_text(self.spark, at)) if exists(self.spark, at) else None

    def version(self) -> int:
        return max(int(n.removesuffix(".json")) for n in children(self.spark, f"{self.path}/manifest") if n.endswith(".json"))

    def _read(self, manifest: dict, kind: str, schema: str, only: set[str] | None = None) -> DataFrame:
        """The rows of a kind, of all partitions or of those named (name/bucket)."""
        paths = [f"{self.path}/{p}" for name, p in manifest["parts"].items() if name.partition("/")[0] == kind and (only is None or name in only)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) as of a version, the last one unless given."""
        manifest = self._manifest(self.version() if version is None else version)
        return self._read(manifest, "nodes", NODES), self._read(manifest, "edges", EDGES)

    def _placed(self, rows: DataFrame, kind: str, name: Column, key: str) -> DataFrame:
        """rows with the column part: kind/name/bucket, the name hex-coded, since it becomes a folder."""
        bucket = F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("string")
        return rows.withColumn("part", F.concat_ws("/", F.lit(kind), F.hex(F.encode(F.coalesce(name, F.lit("")), "UTF-8")), bucket))

    def _write(self, rows: DataFrame, version: str) -> dict[str, str]:
        """Writes rows by part; (part -> folder). There are as many parts as labels and types times buckets."""
        at = f"data/{version}"
        rows.repartition("part").write.partitionBy("part").parquet(f"{self.path}/{at}")
        return {row.part: f"{at}/part={row.part.replace('/', '%2F')}" for row in rows.select("part").distinct().collect()}

    def _checked(self, manifest: dict, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
        """(nodes let in, nodes turned away with the holder of their key, keys to write). Only touched partitions of keys are read."""
        label = F.get("labels", F.lit(0))
        held = [F.when(label == name, F.when(~F.exists(F.array(*(F.get_json_object("props", f"$['{c}']") for c in columns)), lambda x: x.isNull()), F.sha2(F.concat_ws("\\u0001", *(F.get_json_object("props", f"$['{c}']") for c in columns)), 256))) for name, columns in self.unique.items()]
        if not held:
            return nodes, nodes.limit(0).withColumn("holder", F.lit(None).cast("string")), None
        keyed = nodes.withColumn("key_hash", F.coalesce(*held)).withColumn("label", label)
        own = self._placed(keyed.where("key_hash IS NOT NULL").select("label", "key_hash", "node_id"), "keys", F.col("label"), "key_hash")
        own = cut(own, "keys")
        stored = self._read(manifest, "keys", KEYS, {r.part for r in own.select("part").distinct().collect()})
        # who holds a key already keeps it; of several new ones the least id gets it
        taken = stored.select("label", "key_hash", F.col("node_id").alias("holder"))
        first = own.groupBy("label", "key_hash").agg(F.min("node_id").alias("least"))
        holders = first.join(taken, ["label", "key_hash"], "left").select("label", "key_hash", F.coalesce("holder", "least").alias("holder"))
        judged = cut(keyed.join(holders, ["label", "key_hash"], "left"), "judged")
        wrong = F.col("holder").isNotNull() & (F.col("holder") != F.col("node_id"))
        good, bad = judged.where(~wrong).select(*nodes.columns), judged.where(wrong).select(*nodes.columns, "holder")
        keys = self._placed(stored.unionByName(holders.select("label", "key_hash", F.col("holder").alias("node_id"))).distinct(), "keys", F.col("label"), "key_hash")
        return good, bad, keys

    def merge(self, nodes: DataFrame, edges: DataFrame) -> Merge:
        """Puts in nodes_view() and edges_view() rows by their ids; rows of the same id are put together, see _united().

        A node's partition is that of its first label, which never changes. Nodes whose unique key another node holds go to the side table read by rejected(), with the
        holder; an edge's ends needn't be there. Raises Conflict if another merge was
        committed meanwhile; nothing of this one shows then.
        """
        version = self.version()
        manifest = self._manifest(version)
        new_nodes, bad, keys = self._checked(manifest, self._united(nodes.select(*(c.split()[0] for c in NODES.split(", "))), "node_id"))
        new_nodes = cut(self._placed(new_nodes, "nodes", F.get("labels", F.lit(0)), "node_id"), "nodes")
        new_edges = cut(self._placed(self._united(edges.select(*(c.split()[0] for c in EDGES.split(", "))), "edge_id"), "edges", F.col("type"), "edge_id"), "edges")
        touched = {r.part for df in (new_nodes, new_edges) for r in df.select("part").distinct().collect()}
        run, parts = uuid.uuid4().hex, dict(manifest["parts"])
        for kind, schema, new, key in (("nodes", NODES, new_nodes, "node_id"), ("edges", EDGES, new_edges, "edge_id")):
            mine = {p for p in touched if p.startswith(f"{kind}/")}
            if mine:
                old = self._read(manifest, kind, schema, mine)
                both = self._united(old.withColumn("_new", F.lit(0)).unionByName(new.drop("part").withColumn("_new", F.lit(1))), key)
                name = F.get("labels", F.lit(0)) if kind == "nodes" else F.col("type")
                parts |= self._write(self._placed(both, kind, name, key), f"{run}-{kind}")
        if keys is not None:
            parts |= self._write(keys, f"{run}-keys")
        bad.withColumn("version", F.lit(version + 1)).write.parquet(f"{self.path}/rejected/{run}")
        after = manifest | {"parts": parts, "rejected": [*manifest.get("rejected", []), f"rejected/{run}"]}
        if not write_new(self.spark, f"{self.path}/manifest/{version + 1}.json", json.dumps(after)):
            raise Conflict(f"version {version + 1} is there already")
        ids = new_nodes.select("node_id").union(new_edges.select("src")).union(new_edges.select("dst")).where("node_id IS NOT NULL").distinct()
        now = self._read(after, "nodes", NODES).join(ids, "node_id", "left_semi")
        links = self._read(after, "edges", EDGES, touched).join(new_edges.select("edge_id"), "edge_id", "left_semi")
        return Merge(version + 1, now, links, self.spark.read.schema(REJECTED).parquet(f"{self.path}/rejected/{run}"), sorted(touched))

    @staticmethod
    def _united(rows: DataFrame, key: str) -> DataFrame:
        """One row for each id. Rows with _new = 1 are the later merge's, others the earlier one's.

        A property has the later value, null ones never replace any; of several values of one merge the greatest text
        holds. Labels are those of all rows, earlier ones first. Names and labels are put together before rows of one id
        meet, so an id may have any number of rows.
        """
        columns = [c for c in rows.columns if c != "_new"]
        if "_new" not in rows.columns:
            rows = rows.withColumn("_new", F.lit(0))
        rest = [c for c in columns if c not in (key, "labels", "props")]
        props = F.expr("transform(map_entries(coalesce(from_json(props, 'map<string,variant>'), map())), e -> struct('p' AS t, e.key AS k, if(e.value IS NULL OR is_variant_null(e.value), -1, _new) AS n, coalesce(to_json(e.value), 'null') AS v))")
        entries = [props, F.array(*(F.struct(F.lit("r").alias("t"), F.lit(c).alias("k"), F.col("_new").alias("n"), F.col(c).alias("v")) for c in rest), F.struct(F.lit("i").alias("t"), F.lit("").alias("k"), F.lit(0).alias("n"), F.lit("").alias("v")))]
        if "labels" in columns:
            entries.append(F.expr("transform(coalesce(labels, array()), (l, i) -> struct('l' AS t, l AS k, 1 - _new AS n, lpad(cast(1000 - i AS string), 4, '0') AS v))"))
        each = rows.where(F.col(key).isNotNull()).select(key, F.explode(F.concat(*entries)).alias("e")).select(key, "e.t", "e.k", "e.n", "e.v")
        one = each.groupBy(key, "t", "k").agg(F.max(F.struct("n", "v")).alias("x"))
        whole = one.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("t", "k", "x"))).alias("e"))
        values = {
            "props": F.expr("coalesce(to_json(map_from_entries(transform(filter(e, y -> y.t = 'p'), y -> struct(y.k, parse_json(y.x.v))))), '{}')"),
            "labels": F.expr("transform(sort_array(transform(filter(e, y -> y.t = 'l'), y -> struct(y.x AS x, y.k AS k)), false), y -> y.k)"),
            **{c: F.expr(f"filter(e, y -> y.t = 'r' AND y.k = '{c}')[0].x.v") for c in rest},
        }
        return whole.select(*(F.col(c) if c == key else values[c].alias(c) for c in columns))

    def rejected(self) -> DataFrame:
        """Nodes that merges turned away, with the node that holds their key and the version that was made without them."""
        paths = [f"{self.path}/{p}" for p in self._manifest(self.version()).get("rejected", [])]
        return self.spark.read.schema(REJECTED).parquet(*paths) if paths else self.spark.createDataFrame([], REJECTED)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes folders that none of the last versions names, and older manifests but the first; returns the number of folders."""
        last = self.version()
        kept = [self._manifest(v) for v in range(max(0, last - keep + 1), last + 1)]
        used = {p.split("/")[1] for m in kept for p in m["parts"].values()}
        gone = [n for n in children(self.spark, f"{self.path}/data") if n not in used]
        for v in range(1, max(1, last - keep + 1)):
            delete(self.spark, f"{self.path}/manifest/{v}.json")
        for n in gone:
            delete(self.spark, f"{self.path}/data/{n}")
        return len(gone)
