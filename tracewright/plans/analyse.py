"""Whole analyses: of procedural code (definitions, parsed trees, SQL sources) and of classes (parsed trees), and what follows from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import description_text, embedding_text
from ..operators import batching, graph, reports, schema, trees, vectors
from ..sources.tables import cut
from ..streaming.events import Control, Phase
from . import ddl, lineage, providers, summaries
from .summaries import key

_FILE = ["directory", "file"]


@dataclass
class Analysis:
    """The tables of an analysis; all are lazy until used."""

    tables: DataFrame
    columns: DataFrame
    foreign_keys: DataFrame
    nodes: DataFrame
    tree: DataFrame
    batches: DataFrame
    uses: DataFrame
    calls: DataFrame
    summaries: DataFrame
    unit_summaries: DataFrame
    stories: DataFrame
    temporary: DataFrame
    lineage: DataFrame

    def statistics(self) -> DataFrame:
        """(name, n) of each table."""
        rows = [getattr(self, f).agg(F.lit(f).alias("name"), F.count("*").alias("n")) for f in self.__dataclass_fields__]
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        return out

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """The nodes and edges of everything, in the generic form."""
        nodes = graph.nodes_view({"Table": (self.tables, ["schema_name", "table_name"]), "Column": (self.columns, ["fqn"]), "Statement": (self.nodes, [*_FILE, "node_id"])})
        at = lambda c: F.sha2(F.concat_ws("\u0001", F.lit("Statement"), "directory", "file", F.col(c).cast("string")), 256)
        table = lambda s, t: F.sha2(F.concat_ws("\u0001", F.lit("Table"), s, t), 256)
        tree = self.tree.select(at("src").alias("src"), at("dst").alias("dst"), "type")
        used = self.uses.select("src", table("schema_name", "table_name").alias("dst"), "type")
        keys = self.foreign_keys.select(table("schema_name", "table_name").alias("src"), table("to_schema", "to_table").alias("dst"), F.lit("FK_TO_TABLE").alias("type"), "column_name", "to_column")
        edges = graph.edges_view(tree).unionByName(graph.edges_view(used)).unionByName(graph.edges_view(keys))
        return nodes, edges


def analyse(definitions: DataFrame, parsed: DataFrame, sources: DataFrame, case: str = "original", control: Control | None = None) -> Analysis:
    """definitions and sources: file, content; parsed: directory, file, content (JSON trees). Empty inputs give empty tables."""
    control = control or Control()
    control.enter(Phase.DDL)
    tables, columns, keys = ddl.tables(definitions, case), ddl.columns(definitions, case), ddl.foreign_keys(definitions, case)
    control.enter(Phase.AST)
    nodes = cut(trees.flags(trees.flatten(parsed)), "nodes")
    tree = trees.edges(nodes)
    control.enter(Phase.ANALYSIS)
    sized = nodes.where("analysable").withColumn("tokens", F.regexp_count("code", F.lit(r"\w+|[^\w\s]")))
    batches = batching.batch_rows(batching.greedy(sized, _FILE, ["node_id"], "tokens", "has_children"), _FILE)
    units = nodes.where("analysable AND NOT has_children").select(key().alias("unit_id"), *_FILE, "kind", "code")
    plain = units.where("kind <> 'CREATE_TEMP_TABLE'")
    uses = schema.table_uses(providers.table_access(plain).select(F.col("unit_id").alias("src"), "name", "mode"), tables)
    called = providers.calls(units).join(units.select("unit_id", *_FILE), "unit_id").select(*_FILE, F.col("unit_id").alias("src"), "callee")
    named = nodes.where(F.col("kind").isin("PROCEDURE", "FUNCTION")).select(*_FILE, key().alias("node_id"), "name")
    known = summaries.gathered_facts(nodes)
    said = cut(summaries.bottom_up(nodes, known=known), "said")
    whole = cut(summaries.of_units(nodes, said), "units")
    stories = providers.user_stories(known, whole.select(key().alias("unit_id"), "name"))
    of_unit = nodes.where("analysable AND NOT has_children").select(key().alias("src"), key("unit_id").alias("unit_id")).join(nodes.where("unit_id = node_id").select(key().alias("unit_id"), F.col("name").alias("unit")), "unit_id")
    named_columns = schema.table_uses(providers.column_access(plain).select(F.concat_ws("\u0001", "unit_id", "column_name").alias("src"), F.col("table_name").alias("name"), F.lit("r").alias("mode")), tables)
    named_columns = named_columns.select("schema_name", "table_name", F.element_at(F.split("src", "\u0001"), -1).alias("column_name"))
    described = providers.table_descriptions(uses.join(of_unit, "src").select("schema_name", "table_name", "unit", "type"), named_columns)
    control.enter(Phase.LINEAGE)
    return Analysis(
        summaries.described(tables, described), columns, keys, nodes, tree, batches, uses, schema.resolve_calls(called, named), said, whole, reports.numbered_stories(stories),
        providers.temporary_tables(units), lineage.analyse(lineage.procedures(sources)),
    )


@dataclass
class ClassAnalysis:
    """The tables of an analysis of classes; relations are between classes that are known."""

    nodes: DataFrame
    tree: DataFrame
    fields: DataFrame
    methods: DataFrame
    relations: DataFrame
    summaries: DataFrame
    stories: DataFrame
    contexts: DataFrame


def analyse_classes(parsed: DataFrame) -> ClassAnalysis:
    """parsed: directory, file, content (JSON trees of classes). Relations: src, dst, type, detail.

    EXTENDS and IMPLEMENTS from declarations, ASSOCIATION and COMPOSITION from fields, DEPENDENCY from what methods take,
    return and use locally unless a field has it already, CALLS from variable.method calls by the types of the fields. Targets are found by
    name, case ignored; the least node of several.
    """
    nodes = cut(trees.flags(trees.flatten(parsed, "framework"), "framework"), "nodes")
    units = nodes.where(F.col("kind").isin(*fixed.CLASS_TYPES)).select(key().alias("unit_id"), "name", "code")
    # without the lines of methods and inner classes, whose variables are no fields
    held = trees.folded_code(nodes, "placeholder", ("FIELD",)).select(key().alias("unit_id"), "code")
    fields, methods = cut(providers.fields(units.select("unit_id").join(held, "unit_id")), "fields"), cut(providers.methods(units), "methods")
    classes = units.groupBy(F.lower("name").alias("name")).agg(F.min("unit_id").alias("node_id"))
    links = fields.where("target_class IS NOT NULL")
    names = units.select("unit_id", F.col("name").alias("own"))
    body = nodes.where(F.col("kind").isin(*fixed.METHOD_TYPES) & F.col("unit_id").isNotNull())
    bodies = cut(body.select(key("unit_id").alias("unit_id"), key().alias("method_id"), "name", "start_line", "code"), "bodies")
    taken = providers.dependencies(methods).unionByName(providers.local_dependencies(bodies)).join(names, "unit_id").where(F.lower("own") != F.lower("target_class")).drop("own")
    found = (
        providers.inheritance(units).select("unit_id", F.col("to_type").alias("target_class"), F.col("relation").alias("type"), F.lit("").alias("detail"))
        .unionByName(links.select("unit_id", "target_class", F.col("relation").alias("type"), F.concat_ws(" ", "name", "multiplicity").alias("detail")))
        .unionByName(providers.new_dependencies(taken, links).select("unit_id", "target_class", F.lit("DEPENDENCY").alias("type"), F.col("usage").alias("detail")))
        .unionByName(providers.method_calls(units, fields).select("unit_id", "target_class", F.lit("CALLS").alias("type"), F.col("method").alias("detail")))
    )
    relations = providers.resolve_classes(found, classes).select(F.col("unit_id").alias("src"), "dst", "type", "detail").distinct()
    # a class is summed up by its fields and by what is said of its methods, in chunks, in their order
    known = cut(providers.method_facts(bodies.select(F.col("method_id").alias("unit_id"), "code")), "facts")
    of_methods = providers.say(known, bodies.select(F.col("method_id").alias("unit_id")), "method", ("takes", "returns", "calls", "makes"), "that takes, returns and calls nothing")
    spoken = bodies.join(of_methods.withColumnRenamed("unit_id", "method_id"), "method_id")
    whole = summaries.condensed(summaries.chunks(spoken.withColumn("summary", F.concat("name", F.lit(" "), "summary")), ["unit_id"], ["start_line", "method_id"]), ["unit_id"]).withColumnRenamed("summary", "methods")
    named = fields.select("unit_id", "name").distinct().groupBy("unit_id").agg(F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("fields"))
    text = F.concat_ws("\n", F.when(F.length("fields") > 0, F.concat(F.lit("fields "), "fields")), "methods")
    said = units.join(named, "unit_id", "left").join(whole, "unit_id", "left").select("unit_id", "name", F.when(text == "", "class without fields and methods").otherwise(text).alias("summary"))
    said = cut(said, "classes")
    stories = reports.numbered_stories(providers.class_stories(bodies.join(names, "unit_id").withColumnRenamed("own", "class_name"), known))
    return ClassAnalysis(nodes, trees.edges(nodes, "framework"), fields, methods, relations, said, stories, summaries.contexts(nodes, said))


def searchable(a: Analysis) -> DataFrame:
    """The tables of an analysis with vectors of their names and descriptions."""
    blank = a.tables.withColumn("vector", F.lit(None).cast("array<float>"))
    return vectors.vectorise(blank, embedding_text(F.col("table_name"), description_text(F.col("description"), F.col("analysed_description"))))
