"""The registered queries of the operators on metadata, code and graphs: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as X
from . import generated
from .functions import similarity as S
from .functions import text as N
from .operators import batching, glossary, graph, reports, schema, search, trees, vectors
from .plans import analyse, catalog, ddl, detect, fk, lineage, metadata, providers, summaries, waves
from .sources import store
from .sources.tables import cut, shared_dir
from .streaming import events, ledger, runs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Tables whose columns the foreign key queries compare.
STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _files(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "file string, content string")


def _keys(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(X.KEYS, "from_table string, from_column string, to_table string, to_column string, source string")


# Catalogue and foreign keys


@query
def fk_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = catalog.load(spark, sf_dir, STAR)
    found = fk.verify(fk.candidates(catalog.columns(tables)), tables)
    return found.withColumns({"similarity": F.round("similarity", 4), "match_ratio": F.round("match_ratio", 4)})


@query
def fk_candidates_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = catalog.columns(catalog.load(spark, sf_dir, STAR))
    found = fk.candidates(columns, similarity=S.levenshtein_similarity(F.col("a"), F.col("b")))
    return found.select("from_table_name", "from_column_name", "to_table_name", "to_column_name", F.round("similarity", 4).alias("similarity"))


def _verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = catalog.load(spark, sf_dir, (*STAR, "documents", "labels"))
    columns = catalog.columns(tables).where("column_name LIKE '%key' OR column_name = 'doc_id'")
    return fk.verify(fk.candidates(columns, similarity=S.levenshtein_similarity(F.col("a"), F.col("b")), threshold=0.7, both_ways=True), tables)


@query
def fk_verify_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verified(spark, sf_dir).select("from_table_name", "from_column_name", "to_table_name", "to_column_name", "total_samples", "matched_count", F.round("match_ratio", 4).alias("match_ratio"))


@query
def fk_existing_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = catalog.columns(catalog.load(spark, sf_dir, STAR))
    known = _keys(spark).select(F.lit("public").alias("from_schema_name"), F.col("from_table").alias("from_table_name"), F.col("from_column").alias("from_column_name"), F.lit("public").alias("to_schema_name"), F.col("to_table").alias("to_table_name"), F.col("to_column").alias("to_column_name"))
    found = fk.candidates(columns, known, similarity=S.levenshtein_similarity(F.col("a"), F.col("b")), both_ways=True)
    return found.select("from_table_name", "from_column_name", "to_table_name", "to_column_name")


@query
def types_compatible(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog.columns(catalog.load(spark, sf_dir)).select("data_type").distinct()
    pairs = c.join(c.select(F.col("data_type").alias("other")), F.col("data_type") <= F.col("other"))
    return pairs.select("data_type", "other", S.types_compatible(F.col("data_type"), F.col("other")).alias("compatible"))


@query
def table_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = catalog.columns(catalog.load(spark, sf_dir))
    tables = columns.select("schema_name", "table_name").distinct().unionByName(spark.createDataFrame([("public", "empty")], "schema_name string, table_name string"))
    return schema.list_tables(tables.withColumn("description", F.lit(None).cast("string")), columns)


@query
def column_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.list_columns(catalog.columns(catalog.load(spark, sf_dir)), "orders").select("table_name", "column_name", "ordinal")


@query
def table_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part")
    return part.where(schema.matching("ECON", "p_type") | schema.matching("bolt", "p_name")).select("p_partkey", "p_name", "p_type").orderBy("p_name", "p_partkey").limit(100)


@query
def relationship_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.list_relationships(schema.add_relationship(schema.add_relationship(generated.keys(spark, sf_dir), "S1", "other_id", "N7", "id"), "N7", "region_id", "R1", "id"), "N7")


@query
def description_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _t(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("description"), F.lit("ddl").alias("description_source"))
    return schema.describe(nation, {"n_nationkey": 3}, "set by hand")[0]


# Graph


def _place_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, supplier = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "supplier")
    at = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return nation.select(at("R", "n_regionkey").alias("src"), at("N", "n_nationkey").alias("dst")).union(supplier.select(at("N", "s_nationkey"), at("S", "s_suppkey")))


@query
def tree_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.closure(_place_edges(spark, sf_dir))


def _turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes = _t(spark, sf_dir, "conversations").withColumn("node_id", F.concat_ws(":", "conv_id", "turn"))
    return nodes, graph.next_edges(nodes, ["conv_id"], ["turn"])


@query
def next_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir)[1]


@query
def tree_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.depths(*_turns(spark, sf_dir)).select("conv_id", "turn", "depth")


@query
def subtree_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _turns(spark, sf_dir)
    return graph.all_descendants_ok(nodes.withColumn("ok", F.length("text") % 7 != 0), edges).select("conv_id", "turn", "subtree_ok")


@query
def ancestor_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _turns(spark, sf_dir)
    above = nodes.select("node_id", F.col("text").alias("context"), F.length("text").alias("tokens"))
    return batching.contexts_above(edges, above).select("node_id", F.md5("context").alias("context_md5"))


@query
def gathered_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What suppliers are (in debt or in credit), gathered into their nations and regions."""
    facts = _t(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("node_id"), F.when(F.col("s_acctbal") < 0, "debt").otherwise("credit").alias("fact"))
    return graph.gather_up(facts, _place_edges(spark, sf_dir))


@query
def cyclic_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations, each of which goes on from its last turn to its first: a cycle for each conversation."""
    nodes, edges = _turns(spark, sf_dir)
    ends = nodes.groupBy("conv_id").agg(F.max_by("node_id", "turn").alias("src"), F.min_by("node_id", "turn").alias("dst")).select("src", "dst")
    return graph.closure(edges.union(ends), cycles=True)


@query
def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of brass parts as statements, their regions as the units above them."""
    edges = _place_edges(spark, sf_dir)
    region = _t(spark, sf_dir, "region")
    nodes = region.select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("node_id"), F.lit("PROCEDURE").alias("kind"), F.col("r_name").alias("name"))
    uses = _t(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("src"), F.when(F.col("s_acctbal") < 0, "debt").otherwise("credit").alias("table_name"), F.lit("FROM").alias("type"))
    return schema.references(uses, nodes, edges, "debt")


@query
def co_referenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("unit"), F.col("l_partkey").cast("string").alias("table_name"))
    return graph.co_referenced(lines, "7")


@query
def related_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.foreign_related(generated.keys(spark, sf_dir), "N7")


@query
def related_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.related(generated.keys(spark, sf_dir), generated.unit_uses(spark, sf_dir), "N7")


@query
def importance_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.importance(generated.keys(spark, sf_dir)).withColumn("importance", F.round("importance", 4))


@query
def upsert_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.col("s_name")).alias("description"), F.when(F.col("s_suppkey") % 2 == 0, "ddl").otherwise("user").alias("source"), "s_acctbal")
    old, new = s.where("s_suppkey % 5 < 3"), s.where("s_suppkey % 5 > 1").withColumns({"description": F.concat(F.lit("new "), F.col("s_suppkey").cast("string")), "source": F.lit("inferred"), "s_acctbal": F.when(F.col("s_suppkey") % 7 != 0, F.col("s_acctbal") + 1)})
    return graph.upsert(old, new, ["s_suppkey"], {"description": graph.fill_blank("description"), "source": graph.source_priority()})


@query
def detach_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _t(spark, sf_dir, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("node_id"), "c_nationkey")
    edges = _t(spark, sf_dir, "orders").select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("dst"))
    left, links = graph.detach_delete(nodes, edges, F.col("c_nationkey") < 5)
    return left.agg(F.count("*").alias("nodes")).join(links.agg(F.count("*").alias("edges")), F.lit(True))


@query
def edges_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.delete_edges(_t(spark, sf_dir, "lineitem"), F.col("l_quantity") > 45)[1]


@query
def not_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return docs.join(_t(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query
def files_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _t(spark, sf_dir, "documents").select(F.col("source").alias("directory"), F.col("lang").alias("file")).distinct()
    have = _t(spark, sf_dir, "documents").where("n_chars > 20000").select(F.col("source").alias("directory"), F.col("lang").alias("file"))
    return schema.existing_files(have, asked)


@query
def label_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.histogram(_t(spark, sf_dir, "documents").withColumn("labels", F.array("lang", "source")), "labels", every=True)


@query
def conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda c: F.count_if(F.col("event_type") == c)
    return _t(spark, sf_dir, "events").groupBy("user_id").agg(one("click").alias("clicks"), one("view").alias("views"), F.count_if(F.col("value") > 50).alias("large"))


@query
def nested_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("user_id", "event_type", F.get_json_object("props", "$.k").alias("k"))
    per = e.groupBy("user_id", "event_type").agg(F.array_join(F.sort_array(F.collect_set("k")), ",").alias("ks"))
    return per.groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set(F.concat_ws(":", "event_type", "ks"))), ";").alias("sets"))


@query
def graph_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = graph.nodes_view({"Region": (_t(spark, sf_dir, "region"), ["r_regionkey"]), "Nation": (_t(spark, sf_dir, "nation"), ["n_nationkey"])})
    return nodes.select(F.get("labels", F.lit(0)).alias("label"), F.col("node_id"))


# Analysis phases


@query
def wave_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated trees, four levels deep, analysed from the leaves up: each parent is asked about with its children's results."""
    nodes = trees.flags(trees.flatten(generated.deep_trees(spark, sf_dir), columns=("directory", "file", "node_id", "parent_id", "kind", "start_line", "end_line", "code", "runs", "has_children", "height", "parent_height")))
    done = waves.analyse(nodes, waves.digest_rule, f"{shared_dir(spark)}/waves-{uuid.uuid4().hex}")
    return done.select("file", "node_id", "summary", "ok")


@query
def qualified_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.list_columns(catalog.columns(catalog.load(spark, sf_dir)), "PUBLIC.Orders").select("table_name", "column_name")


@query
def column_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns as statements spell them (upper case, every second one; one that is unknown), as the catalogue writes them."""
    known = catalog.columns(catalog.load(spark, sf_dir))
    used = known.select("schema_name", F.upper("table_name").alias("table_name"), F.when(F.col("ordinal") % 2 == 0, F.upper("column_name")).otherwise(F.col("column_name")).alias("column_name"))
    used = used.union(known.select("schema_name", F.upper("table_name"), F.lit("Other")).distinct())
    return schema.column_uses(used, known).select("table_name", "column_name")


@query
def filled_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank column descriptions filled from the first rows of each table; one is described already."""
    tables = {"orders": _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "customer": _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")}
    columns = catalog.columns(tables).select("table_name", "column_name", F.when(F.col("column_name") == "c_name", "who").otherwise(" ").alias("description"), F.lit("ddl").alias("description_source"))
    return metadata.fill(columns, tables, {"orders": "o_orderkey", "customer": "c_custkey"})[0]


@query
def saved_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inferred keys put in beside the known ones: those of the definition stay so, those set by a user get the inferred values."""
    known = _keys(spark).select(F.concat(F.lit("public."), "from_table").alias("src"), F.concat(F.lit("public."), "to_table").alias("dst"), F.lit("FK_TO_TABLE").alias("type"), F.col("from_column").alias("source_column"), F.col("to_column").alias("target_column"), F.lit("many_to_one").alias("cardinality"), "source", F.lit(None).cast("double").alias("similarity"), F.lit(None).cast("double").alias("match_ratio"))
    out = metadata.save_keys(known, _verified(spark, sf_dir))
    return out.select("src", "dst", "source_column", "target_column", "source", F.round("match_ratio", 4).alias("match_ratio"))


@query
def described_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables that nations' suppliers read and write, one of them described already, and one that nobody uses."""
    s = _t(spark, sf_dir, "supplier").join(_t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    uses = s.select(F.lit("public").alias("schema_name"), F.when(F.col("s_acctbal") < 0, "debt").otherwise("credit").alias("table_name"), F.col("n_name").alias("unit"), F.when(F.col("s_suppkey") % 2 == 0, "FROM").otherwise("WRITES").alias("type"))
    tables = spark.createDataFrame([("public", "debt", None), ("public", "credit", "known"), ("public", "unused", "")], "schema_name string, table_name string, description string")
    return summaries.described(tables, providers.table_descriptions(uses, most=None)).drop("schema_name")


@query
def story_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories of nations as units, whose suppliers read and write a few tables."""
    facts = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("unit_id"), F.when(F.col("s_acctbal") < 0, "writes").otherwise("reads").alias("fact"), F.concat(F.lit("t"), (F.col("s_suppkey") % 5).cast("string")).alias("name"))
    units = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("unit_id"), F.col("n_name").alias("name"))
    out = reports.numbered_stories(providers.user_stories(facts, units))
    return out.select("unit_id", "story_id", "role", "goal", "benefit", F.get("criteria", F.lit(0))["criterion_id"].alias("criterion_id"))


@query
def summary_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as summaries of twenty units, dealt into chunks by tokens."""
    turns = _t(spark, sf_dir, "conversations").select((F.col("conv_id") % 20).alias("unit"), "conv_id", "turn", F.col("role").alias("name"), F.col("text").alias("summary"))
    out = summaries.chunks(turns, ["unit"], ["conv_id", "turn"], limit=400)
    return out.select("unit", "batch", F.size("parts").alias("n"), "tokens", F.md5(F.array_join("parts", "\n")).alias("parts_md5"))


def _classes(spark: SparkSession, sf_dir: str) -> analyse.ClassAnalysis:
    one = spark.createDataFrame([("d", "A.java", X.CLASSES)], "directory string, file string, content string")
    return analyse.analyse_classes(one.union(generated.classes(spark, sf_dir)))


@query
def class_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of classes made from suppliers, and of some written by hand."""
    a = _classes(spark, sf_dir)
    names = a.summaries.select("unit_id", "name")
    at = a.relations.join(names.withColumnsRenamed({"unit_id": "src", "name": "from_class"}), "src").join(names.withColumnsRenamed({"unit_id": "dst", "name": "to_class"}), "dst")
    return at.select("from_class", "to_class", "type", "detail")


@query
def class_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said of classes, from their fields and from what is said of their methods."""
    return _classes(spark, sf_dir).summaries.select("name", "summary")


@query
def class_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A story for each method of a class, with its criterion."""
    a = _classes(spark, sf_dir)
    out = a.stories.join(a.summaries.select("unit_id", "name"), "unit_id")
    return out.select("name", "story_id", "role", "goal", "benefit", F.get("criteria", F.lit(0))["criterion_id"].alias("criterion_id"), F.get("criteria", F.lit(0))["title"].alias("title"))


@query
def class_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the classes above methods say of themselves."""
    a = _classes(spark, sf_dir)
    at = a.nodes.where("kind = 'METHOD'").select(summaries.key().alias("unit_id"), "file", "name")
    return a.contexts.join(at, "unit_id").select("file", "name", "context")


@query
def temporary_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return providers.temporary_tables(spark.createDataFrame(X.TEMPORARY, "unit_id string, kind string, code string").union(generated.temporaries(spark, sf_dir)))


@query
def ancestor_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the procedures, loops and branches above the statements of generated trees say of themselves."""
    nodes = cut(trees.flags(trees.flatten(generated.deep_trees(spark, sf_dir), columns=("directory", "file", "node_id", "parent_id", "kind", "name", "start_line", "end_line", "frame", "has_children", "depth", "above"))), "parsed")
    return summaries.node_contexts(nodes).select("file", "node_id", "context")


@query
def report_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").select((F.col("o_custkey") % 10).alias("unit"), F.col("o_orderkey").alias("line"), F.col("o_orderstatus").alias("kind"), F.concat(F.lit("<"), "o_orderpriority", F.lit(">")).alias("text"))
    counted = reports.totals(o.select("unit", F.col("kind").alias("table_name"), F.col("line").alias("statement"), F.lit(1).alias("tokens")))
    usage = reports.table_usage(o.select("unit", F.col("kind").alias("table_name"), F.lit("r").alias("operation"), "line", F.lit("c").alias("context")))
    out = reports.report(usage, counted, o, 3)
    return out.select("section", "unit", "html")


# Statements, batches, code


@query
def greedy_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("source", "doc_id", F.col("n_chars").alias("tokens"), (F.col("doc_id") % 11 == 0).alias("alone"))
    return batching.greedy(docs, ["source"], ["doc_id"], "tokens", "alone", limit=5000).select("source", "doc_id", "batch")


@query
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("unit"), F.col("o_orderkey").alias("start_line"), (F.col("o_orderkey") + 1).alias("end_line"), F.col("o_orderpriority").alias("kind"), (F.col("o_orderstatus") == "F").alias("is_dml"), (F.col("o_orderkey") % 400).alias("tokens"))
    b = batching.batch_rows(batching.greedy(o, ["unit"], ["start_line"], "tokens"), ["unit"])
    return b.select("unit", "batch", F.size("ranges").alias("n_ranges"), F.size("dml_ranges").alias("n_dml"), "tokens", "progress_line")


@query
def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = spark.createDataFrame([(1, 1, 10), (2, 5, 25), (3, 24, 50)], "band int, low int, high int")
    lines = _t(spark, sf_dir, "lineitem").join(F.broadcast(bands), F.col("l_quantity").between(F.col("low"), F.col("high")))
    return lines.groupBy("band", "l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def _tree(spark: SparkSession, sf_dir: str, columns: tuple[str, ...]) -> DataFrame:
    one = spark.createDataFrame([("d", "f.sql", X.TREE)], "directory string, file string, content string")
    return trees.flatten(one.union(generated.trees(spark, sf_dir)), columns=("directory", "file", "node_id", *columns))


@query
def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.by_depth(trees.flags(_tree(spark, sf_dir, ("parent_id", "kind", "has_children", "unit_id", "depth")))).select("file", "node_id", "parent_id", "kind", "unit_id", "depth", "analysable", "is_dml", "needs_context")


@query
def tree_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.edges(_tree(spark, sf_dir, ("parent_id", "kind", "parent_kind", "next_id"))).select("file", "src", "dst", "type")


@query
def tree_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = cut(_tree(spark, sf_dir, ("parent_id", "kind", "start_line", "end_line", "code", "has_children")), "parsed")  # read by each style
    said = n.where("node_id % 3 = 0").select("directory", "file", "node_id", F.concat(F.lit(" does "), "node_id", F.lit(" ")).alias("summary"))
    out = [trees.folded_code(n, s, summaries=said if s == "compact" else None).select(F.lit(s).alias("style"), "file", "node_id", "code") for s in ("skeleton", "placeholder", "compact")]
    return out[0].union(out[1]).union(out[2])


# Texts


def _definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, X.DDL).union(generated.definitions(spark, sf_dir))


@query
def ddl_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ddl.tables(_definitions(spark, sf_dir))


@query
def ddl_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ddl.columns(_definitions(spark, sf_dir)).drop("ordinal")


@query
def ddl_foreign_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ddl.foreign_keys(_definitions(spark, sf_dir))


@query
def ddl_primary_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ddl.primary_keys(_definitions(spark, sf_dir))


@query
def ddl_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ddl.statistics(_definitions(spark, sf_dir))


@query
def lineage_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lineage.analyse(lineage.procedures(_files(spark, X.SQL).union(generated.procedures(spark, sf_dir))))
    return out.select("file", "etl_name", F.array_join("source_tables", ",").alias("sources"), F.array_join("target_tables", ",").alias("targets"), "operation_type", "is_etl")


@query
def lineage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.edges(lineage.analyse(lineage.procedures(_files(spark, X.SQL).union(generated.procedures(spark, sf_dir)))))


@query
def lineage_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.graph(lineage.analyse(lineage.procedures(_files(spark, X.SQL).union(generated.procedures(spark, sf_dir)))))[0]


@query
def lineage_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.statistics(lineage.analyse(lineage.procedures(_files(spark, X.SQL).union(generated.procedures(spark, sf_dir)))))


@query
def lineage_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table names that FROM and JOIN precede in all documents and pages, as units of their own."""
    docs = _t(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("file"), F.col("text").alias("content"))
    docs = docs.union(_t(spark, sf_dir, "pages").select(F.concat(F.lit("page"), F.col("page_id").cast("string")), "html"))
    units = docs.where("content IS NOT NULL").select("file", F.col("file").alias("etl_name"), F.col("content").alias("body"))
    return lineage.analyse(units).select("file", F.array_join("source_tables", ",").alias("sources"))


def _all_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file"), F.col("text").alias("content"))
    pages = _t(spark, sf_dir, "pages").select(F.concat(F.lit("page"), F.col("page_id").cast("string"), F.lit(".xml")).alias("file"), F.col("html").alias("content"))
    return docs.union(pages).union(_files(spark, X.FILES))


@query
def detect_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detect.detect(_all_files(spark, sf_dir))
    return out.select("file", "file_type", F.round("confidence", 4).alias("confidence"), "details", "suggested_strategy", "suggested_target")


@query
def detect_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.votes(detect.detect(_all_files(spark, sf_dir))).select("kind", "choice", "n", F.round("weight", 4).alias("weight"), "is_first")


@query
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame(list(enumerate(X.NAMES)), "i long, name string").union(generated.names(spark, sf_dir))
    return df.select("i", N.table_identifier(F.col("name")).alias("t")).select("i", F.col("t.schema").alias("schema_name"), F.col("t.table").alias("table_name"), "t.db_link")


@query
def default_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame(list(enumerate(X.PATHS)), "i long, path string").union(generated.paths(spark, sf_dir))
    return df.select("i", N.default_schema(F.col("path"), F.array(F.lit("Sales"), F.lit("DW"))).alias("schema_name"))


@query
def fqns(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "region")
    return n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", N.fqn(F.col("r_name"), F.lit(""), F.col("n_name")).alias("fqn"), N.safe_name(F.concat(F.lit(" "), "r_name", F.lit("/"), "n_name")).alias("safe"), N.html_escape(F.concat(F.lit("<&'\">"), "n_name")).alias("html"))


@query
def procedure_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame(list(enumerate(X.CODES)), "i long, code string").union(generated.heads(spark, sf_dir))
    return df.select("i", N.procedure_name(F.col("code")).alias("p")).select("i", F.col("p.schema").alias("schema_name"), F.col("p.name").alias("name"))


@query
def domain_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(X.CLASS_NAMES)), "i int, name string").union(generated.class_names(spark, sf_dir)).select("i", N.is_domain_class(F.col("name")).alias("is_domain"))


@query
def table_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = ddl.tables(_definitions(spark, sf_dir))
    return schema.table_uses(spark.createDataFrame(X.DML, "src string, name string, mode string").union(generated.uses(spark, sf_dir)), known)


@query
def provider_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return providers.table_access(_files(spark, X.SQL).withColumnsRenamed({"file": "unit_id", "content": "code"}).union(generated.statements(spark, sf_dir)))


@query
def join_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return providers.join_keys(generated.statements(spark, sf_dir))


@query
def column_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return providers.column_access(generated.statements(spark, sf_dir))


@query
def use_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What order lines say of each ship mode of a part size: sets, first and last by order."""
    o = _t(spark, sf_dir, "orders").select(F.lit("public").alias("schema_name"), F.col("o_orderpriority").alias("table_name"), F.col("o_orderstatus").alias("column_name"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" d"), (F.col("o_custkey") % 4).cast("string"))).alias("description"), F.when(F.col("o_orderkey") % 2 == 0, (F.col("o_orderkey") % 10).cast("string")).alias("dtype"), (F.col("o_custkey") % 2 == 0).alias("nullable"), (F.col("o_custkey") % 9).cast("string").alias("example"))
    out = schema.summarise_uses(o)
    return out.select("table_name", "column_name", F.array_join("descriptions", "|").alias("descriptions"), "dtype", "nullable", F.array_join("examples", "|").alias("examples"))


# Vectors


@query
def semantic_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    probe = e.where("vec_id = 0").select(F.col("embedding").alias("probe"))
    found = vectors.search(e.join(F.broadcast(probe), F.lit(True)), F.col("probe"), limit=20, name="vec_id", vector="embedding", candidates=400, least=0.05)
    return found.select("vec_id", "similarity")


@query
def semantic_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part").select(F.lit("").alias("schema_name"), F.col("p_partkey").cast("string").alias("table_name"), F.concat_ws(" ", "p_name", "p_type").alias("description"))
    first = part.orderBy("table_name").first()
    return vectors.search_text(part, first.description if first else "", 5, candidates=None)


@query
def prefix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.by_prefix(_t(spark, sf_dir, "nation"), "nation_1x9", "n_name")


@query
def ranked_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = generated.keys(spark, sf_dir)
    names = known.select(F.col("from_table").alias("table_name")).union(spark.createDataFrame([("alone",)], "table_name string")).distinct()
    out = search.ranked(names.withColumn("similarity", F.length("table_name") / 10), graph.importance(known))
    return out.select("table_name", F.round("score", 4).alias("score"))


@query
def past_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 50).alias("similarity"), (F.col("p_partkey") % 11 / 10).alias("success_rate"), (F.col("p_partkey") % 3 / 2).alias("usage"))
    return search.past_questions(c, "p_partkey").select("p_partkey", F.round("final_score", 4).alias("final_score"), "rank", "action")


def _letters(texts: list[str]) -> list[str]:
    """A provider of vectors without a model: length, vowels and digits of a text."""
    return [f"[{len(t)}, {sum(c in 'aeiou' for c in t)}, {sum(c.isdigit() for c in t)}]" for t in texts]


@query
def provided_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of part names from a provider, each different name asked for once; every third part has one already."""
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_name", F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit(1.0).cast("float"))).alias("vector"))
    out = vectors.vectorise_by(part, F.col("p_name"), _letters, f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}")
    return out.select("p_partkey", F.array_join(F.transform("vector", lambda x: x.cast("int").cast("string")), ",").alias("vector"))


@query
def recalled_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector as a question, all others as past questions, the nearest ten of each re-ranked."""
    e = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    asked = e.where("key % 100 = 0").select(F.col("key").alias("question_id"), "vector")
    stored = e.where("key % 100 <> 0").withColumns({"success_rate": F.col("key") % 11 / 10, "usage": F.col("key") % 3 / 2})
    return search.recalled(asked, stored, 10).withColumn("final_score", F.round("final_score", 6))


@query
def mapped_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = _t(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_type")).otherwise(F.concat("p_type", F.lit("x"))).alias("term")).distinct()
    values = _t(spark, sf_dir, "part").select(F.col("p_type").alias("value"))
    return search.map_values(terms, values, measure=S.levenshtein_similarity(F.col("a"), F.col("b")))


@query
def mapped_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misspelt names of parts, mapped by letters in matching blocks, and only those whose value stands in the column."""
    part = _t(spark, sf_dir, "part")
    terms = part.select(F.expr("CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN concat(p_name, 'x') WHEN 2 THEN substring(p_name, 2) ELSE reverse(p_name) END").alias("term"))
    found = search.map_values(terms, part.select(F.col("p_name").alias("value")))
    at = lambda df: df.withColumns({"table_name": F.lit("part"), "column_name": F.lit("p_name")})
    return search.existing(at(found), at(part.where("p_size > 5").select(F.col("p_name").alias("value"))))[0].select("term", "value", "kind")


# Glossary, stars, reports, events


@query
def glossary_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, t, _ = generated.glossary(spark, sf_dir)
    return glossary.list_glossaries(g, t)


@query
def glossary_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, t, links = generated.glossary(spark, sf_dir)
    out = glossary.list_terms(t, links, limit=None)
    return out.select("term_id", "name", "status", *(F.array_join(c, ",").alias(c) for c in ("domains", "owners", "tags")))


@query
def star_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = catalog.columns(catalog.load(spark, sf_dir, STAR))
    keys = _keys(spark).select("from_table", F.col("from_column").alias("column_name"), "to_table", "to_column")
    each = columns.join(keys, (columns.table_name == keys.from_table) & (columns.column_name == keys.column_name), "left")
    cube = each.groupBy(F.lit("sales").alias("cube_name"), F.col("schema_name"), F.col("table_name"), F.when(F.col("table_name") == "lineitem", "FACT").otherwise("DIMENSION").alias("table_type")).agg(F.array_sort(F.collect_list(F.struct(columns.column_name.alias("name"), F.col("data_type").alias("dtype"), F.lit(False).alias("is_pk"), F.col("to_table").isNotNull().alias("is_fk"), F.col("to_table").alias("fk_table"), F.col("to_column").alias("fk_column")))).alias("columns"))
    return schema.star_tables(cube)[2]


@query
def report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("unit"), F.col("l_partkey").alias("table_name"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("statement"), F.col("l_quantity").cast("long").alias("tokens"))
    return reports.totals(li)


@query
def table_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("unit"), F.col("l_linestatus").alias("table_name"), F.col("l_returnflag").alias("operation"), F.col("l_orderkey").alias("line"), F.col("l_orderkey").cast("string").alias("context"))
    return reports.table_usage(li)


@query
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.progress(_t(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], ["event_id"], 50, 100)


@query
def event_ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.lit("message").alias("type"), F.col("event_type").alias("content"), F.when(F.col("event_id") % 2 == 0, F.col("user_id")).alias("line_number"))
    return events.ndjson(e)


@query
def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts by type from a stream over the events table, run until all is read."""
    source = _t(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    source.write.parquet(f"{folder}/in")
    counts = events.stream_counts(spark, f"{folder}/in", source.schema, "ts", "event_type", late="365 days")
    written = f"{folder}/out"

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(written)

    counts.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(written).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query
def run_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's day as a run: its events in a stream, ended by large errors and purchases or by idle hours, each run once."""
    kind = "CASE WHEN event_type = 'error' AND value > 50 THEN 'error' WHEN event_type = 'purchase' AND value > 80 THEN 'complete' WHEN event_type = 'signup' THEN 'phase_event' ELSE 'message' END"
    e = _t(spark, sf_dir, "events").select(F.expr("concat(user_id, '/', date_format(ts, 'yyyy-MM-dd'))").alias("run_id"), F.col("event_id").alias("seq"), F.expr(kind).alias("type"), F.col("event_type").alias("content"), F.expr("CASE WHEN event_type = 'signup' THEN 2.0D END").alias("phase"), F.col("ts").cast("timestamp").alias("ts"))
    folder = f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}"
    e.write.parquet(f"{folder}/in")
    runs.follow(spark.readStream.schema(e.schema).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/state", late="1 hour", idle=6 * 3600, idle_asking=9 * 3600).awaitTermination()
    return spark.read.schema(runs.OUT).parquet(f"{folder}/out")


@query
def store_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers in a stored graph after two merges that overlap; second nodes with the key of another one are turned away."""
    s = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    node = lambda df, props: df.select(graph.node_id("Supplier", "k").alias("node_id"), F.array(F.lit("Supplier")).alias("labels"), F.expr(f"to_json({props})").alias("props"))
    none = spark.createDataFrame([], store.EDGES)
    kept = store.Store(spark, f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}", buckets=4, unique={"Supplier": ["k"]})
    kept.merge(node(s.where("k % 5 < 3"), "named_struct('k', k, 'n', 'old')"), none)
    second = node(s.where("k % 10 = 0"), "named_struct('k', k)").withColumn("node_id", F.concat(F.lit("second-"), F.get_json_object("props", "$.k")))
    kept.merge(node(s.where("k % 5 > 1"), "named_struct('d', k % 7, 'k', k, 'n', 'new')").union(second), none)
    out = kept.read()[0].select(F.lit("node").alias("kind"), "node_id", "props", F.lit(None).cast("string").alias("holder"))
    return out.unionByName(kept.rejected().select(F.lit("rejected").alias("kind"), "node_id", "props", "holder"))


@query
def ledger_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files: what two phases came to, and whether each is pending for the second one."""
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("directory"), F.col("o_orderkey").cast("string").alias("file"), F.col("o_orderkey").alias("k"))
    book = ledger.Ledger(spark, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}")
    book.append(o.where("k % 5 = 0"), 1, ledger.failed(1), "broken")
    book.append(o.where("k % 5 > 1"), 1, ledger.ok(1))
    book.append(o.where("k % 10 = 0"), 1, ledger.ok(1))  # went well the second time
    book.append(o.where("k % 5 = 3"), 2, ledger.ok(2))
    book.append(o.where("k % 15 = 4"), 2, ledger.failed(2), "later")
    open_files = book.pending(o, 2).withColumn("pending", F.lit(True))
    return book.state(o).join(open_files, ["directory", "file"], "left").select("directory", "file", "status", "message", F.coalesce("pending", F.lit(False)).alias("pending"))


@query
def tree_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.heights(*_turns(spark, sf_dir)).select("conv_id", "turn", "height")


@query
def node_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the nodes of generated trees are called."""
    n = trees.flatten(generated.deep_trees(spark, sf_dir), columns=("directory", "file", "node_id", "kind", "name", "start_line"))
    return n.select("file", "node_id", N.node_name(F.col("kind"), F.col("name"), F.col("file"), F.col("start_line")).alias("name"))


@query
def first_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplier with the least balance of each nation, and the first names of its suppliers."""
    s = _t(spark, sf_dir, "supplier")
    names = s.groupBy("s_nationkey").agg(F.sort_array(F.collect_list("s_name")).alias("names")).select("s_nationkey", reports.preview("names", 2).alias("preview"))
    return ddl.ranked_duplicates(s, ["s_nationkey"], ["s_acctbal", "s_suppkey"]).select("s_nationkey", "s_suppkey").join(names, "s_nationkey")
