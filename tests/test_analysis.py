import json

from tracewright import fixtures as X
from tracewright import queries
from tracewright.operators import trees
from tracewright.plans import metadata, summaries
from tracewright.plans.analyse import analyse, analyse_classes, searchable
from tracewright.sources import store


def test_a_whole_analysis(spark, tmp_path):
    files = lambda rows: spark.createDataFrame(rows, "file string, content string")
    trees = spark.createDataFrame([("d", "f.sql", X.TREE)], "directory string, file string, content string")
    a = analyse(files(X.DDL), trees, files(X.SQL))
    n = {r.name: r.n for r in a.statistics().collect()}
    assert n == {"tables": 3, "columns": 6, "foreign_keys": 2, "nodes": 5, "tree": 5, "batches": 2, "uses": 1, "calls": 0, "summaries": 2, "unit_summaries": 1, "stories": 1, "temporary": 0, "lineage": 4}
    nodes, edges = a.graph()
    store.write_graph(nodes, edges, str(tmp_path / "g"))
    nodes, edges = store.read_graph(spark, str(tmp_path / "g"))
    got = {(r.kind, r.name): r.n for r in store.counts(nodes, edges).collect()}
    assert got == {("node", "Table"): 3, ("node", "Column"): 6, ("node", "Statement"): 5, ("edge", "CONTAINS"): 1, ("edge", "PARENT_OF"): 3, ("edge", "NEXT"): 1, ("edge", "WRITES"): 1, ("edge", "FK_TO_TABLE"): 2}
    ids = {r.node_id for r in nodes.collect()}
    assert all(r.src in ids for r in edges.collect()) and searchable(a).where("size(vector) = 64").count() == 3
    empty = analyse(files([]), trees.limit(0), files([]))
    assert {r.n for r in empty.statistics().collect()} == {0}


def test_classes_and_what_links_them(spark):
    parsed = spark.createDataFrame([("d", "A.java", X.CLASSES)], "directory string, file string, content string")
    a = analyse_classes(parsed)
    assert {r.type for r in a.tree.collect()} == {"CONTAINS", "HAS_METHOD", "HAS_FIELD"} and a.relations.count() == len(X.RELATIONS)
    assert {r.name: r.summary for r in a.summaries.collect()}["OrderService"] == "fields count, customers, store\nbill takes Customer, int; returns Invoice; calls store.save"
    (story,) = a.stories.collect()
    assert (story.story_id, story.role, story.goal, story.benefit, story.criteria[0].criterion_id) == ("US-1", "user of OrderService", "bill", "get Invoice", "AC-1-1")
    (context,) = a.contexts.collect()
    assert context.context.startswith("[CONTEXT]\nCLASS OrderService 1~12: fields count, customers, store\nbill takes")
    empty = analyse_classes(parsed.limit(0))
    assert empty.relations.count() == empty.stories.count() == empty.contexts.count() == 0


def test_local_variables_are_dependencies_and_no_fields(spark):
    code = "1: class A {\n2:   private B b;\n3:   void run(int n) {\n4:     final C c = new D();\n5:     Map<String, E> m = null;\n6:     B other;\n7:   }\n8: }"
    method = "3:   void run(int n) {\n4:     final C c = new Dee();\n5:     B other = b;\n6:     return;\n7:   }"
    unit = {"type": "CLASS", "name": "A", "startLine": 1, "endLine": 8, "code": code, "children": [{"type": "METHOD", "name": "run", "startLine": 3, "endLine": 7, "code": method, "children": []}]}
    others = [{"type": "CLASS", "name": n, "startLine": 20 + i, "endLine": 20 + i, "code": f"{20 + i}: class {n} {{ }}", "children": []} for i, n in enumerate(("B", "C", "Dee"))]
    content = json.dumps({"type": "FILE", "startLine": 1, "endLine": 30, "code": "", "children": [unit, *others]})
    a = analyse_classes(spark.createDataFrame([("d", "A.java", content)], "directory string, file string, content string"))
    names = {r.unit_id: r.name for r in a.summaries.collect()}
    got = {(names[r.src], names[r.dst], r.type, r.detail) for r in a.relations.collect()}
    # one letter is no class worth a link when it is called, B is known as a field
    assert ("A", "Dee", "DEPENDENCY", "local") in got and not any(r[2:] == ("DEPENDENCY", "local") and r[1] == "B" for r in got)
    assert [r.name for r in a.fields.collect()] == ["b"]


def test_summaries_climb_and_failures_too(spark):
    nodes = trees.flags(trees.flatten(spark.createDataFrame([("d", "f.sql", X.TREE)], "directory string, file string, content string")))
    said = {r.node_id: r.summary for r in summaries.bottom_up(nodes).collect()}
    assert said == {2: "writes T", 3: "writes T"}
    units = summaries.of_units(nodes, summaries.bottom_up(nodes))
    assert [(r.name, r.summary) for r in units.collect()] == [("P_LOAD", "writes T")]
    failed = spark.createDataFrame([("d", "f.sql", 2)], "directory string, file string, node_id int")
    broken = summaries.bottom_up(nodes, failed)
    assert {(r.node_id, r.summary, r.ok) for r in broken.collect()} == {(2, None, False), (3, None, False)} and summaries.of_units(nodes, broken).count() == 0


def test_profiles_fill_blanks_and_failures_are_named(spark):
    columns = spark.createDataFrame([("t", "a", None, "ddl"), ("t", "b", "known", "ddl"), ("gone", "x", "", "ddl")], "table_name string, column_name string, description string, description_source string")
    tables = {"t": spark.createDataFrame([(2, "y"), (1, None)], "a int, b string"), "gone": spark.createDataFrame([(1,)], "x int")}
    out, failed = metadata.fill(columns, tables, {"gone": "no_such_column"})
    assert {(r.column_name, r.description, r.description_source) for r in out.collect()} == {("a", "1 to 2, 2 different", "sample"), ("b", "known", "ddl"), ("x", "", "ddl")} and failed == ["gone"]


def test_inferred_keys_of_the_smallest_tables(spark, sf):
    got = {(r.from_table_name, r.from_column_name, r.to_table_name, r.to_column_name, r.total_samples, r.match_ratio) for r in queries.fk_inference(spark, sf).collect()}
    assert got == {
        ("lineitem", "l_suppkey", "supplier", "s_suppkey", 10, 1.0), ("nation", "n_regionkey", "region", "r_regionkey", 5, 1.0), ("lineitem", "l_orderkey", "orders", "o_orderkey", 25, 1.0),
        ("lineitem", "l_partkey", "part", "p_partkey", 25, 1.0), ("customer", "c_nationkey", "nation", "n_nationkey", 25, 1.0), ("customer", "c_custkey", "orders", "o_custkey", 25, 1.0),
    }


def test_a_table_whose_file_is_gone_is_named_and_the_rest_filled(spark, tmp_path):
    for name in ("good", "lost"):
        spark.createDataFrame([(1,), (3,)], "x int").coalesce(1).write.parquet(str(tmp_path / name))
    read = {name: spark.read.schema("x int").parquet(str(tmp_path / name)) for name in ("good", "lost")}
    for f in (tmp_path / "lost").glob("*.parquet"):
        f.unlink()
    columns = spark.createDataFrame([("good", "x", "", "ddl"), ("lost", "x", "", "ddl")], "table_name string, column_name string, description string, description_source string")
    out, failed = metadata.fill(columns, read)
    assert failed == ["lost"] and {(r.table_name, r.description) for r in out.collect()} == {("good", "1 to 3, 2 different"), ("lost", "")}
