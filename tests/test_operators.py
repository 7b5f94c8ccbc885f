import json
import random
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from tracewright import fixtures as X
from tracewright.functions import similarity as S
from tracewright.functions import text as N
from tracewright.operators import batching, glossary, graph, reports, schema, search, similar, trees, vectors
from tracewright.plans import ddl, detect, fk, lineage, providers
from tracewright.plans.needed import NEEDED

ANY = st.text(alphabet="ab _c", max_size=8)


@given(ANY, ANY)
def test_similarities_are_symmetric_and_bounded(a, b):
    for f in (S.indel, S.partial, S.token_ratio, S.weighted):
        assert 0 <= f(a, b) <= 1 and abs(f(a, b) - f(b, a)) < 1e-9
    assert S.indel(a, a) == 1


def test_similarity_of_known_names(spark):
    assert S.indel("l_orderkey", "o_orderkey") == 0.9 and S.lcs("abcde", "ace") == 3
    df = spark.createDataFrame([("L_orderkey", "o_orderkey"), ("id", "id"), (None, "x")], "a string, b string")
    assert [round(r.s, 3) for r in df.select(S.name_similarity("a", "b").alias("s")).collect()] == [0.9, 1.0, 0.0]


def test_type_families(spark):
    pairs = [("bigint", "NUMBER(10)", True), ("varchar", "date", False), ("", "x", True), (None, "x", True), ("Date", "TIMESTAMP", True), ("blob", "blob", True), ("blob", "int", False)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert all(r.want == r.got for r in df.withColumn("got", S.types_compatible(F.col("a"), F.col("b"))).collect())


def greedy(tokens, alone, limit):
    out, batch, used = [], 0, 0
    for t, a in zip(tokens, alone, strict=True):
        if a or not batch or used + t > limit:
            batch, used = batch + 1, limit + 1 if a else t
        else:
            used += t
        out.append(batch)
    return out


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 1500), st.booleans()), min_size=1, max_size=12), min_size=1, max_size=5))
def test_batches_match_the_plain_fold(spark, groups):
    rows = [(g, i, t, a) for g, xs in enumerate(groups) for i, (t, a) in enumerate(xs)]
    got = batching.greedy(spark.createDataFrame(rows, "g int, i int, tokens int, alone boolean"), ["g"], ["i"], "tokens", "alone").orderBy("g", "i").collect()
    for g, xs in enumerate(groups):
        assert [r.batch for r in got if r.g == g] == greedy([t for t, _ in xs], [a for _, a in xs], batching.BATCH)
        sums = {}
        for r in got:
            if r.g == g:
                sums.setdefault(r.batch, []).append(r)
        assert all(len(b) == 1 or sum(r.tokens for r in b) <= batching.BATCH and not any(r.alone for r in b) for b in sums.values())


def test_threads_tell_the_fold_from_every_open_batch():
    r = random.Random(4)
    for _ in range(300):
        limit = r.choice((3, 10, 30))
        xs = [(r.random() < r.choice((0, 0.1)), None if r.random() < 0.02 else r.randrange(r.choice((2, 5, limit + 5)))) for _ in range(r.randrange(1, 40))]
        threads = batching._Threads(limit)
        for a, x in xs:
            threads.add(a, x)
        made = threads.made()
        m = Row(**made | {k: made[k] and Row(**made[k]) for k in ("rest", "none")})
        assert len(m.bounds) <= limit + 2
        for t in (None, *range(limit + 4)):
            b, u = 7, t
            for a, x in xs:
                b, u = batching._step(b, u, a, x, limit)
            assert batching._after(m, 7, t, limit) == (b, u)


def test_a_group_of_all_rows_is_batched_by_many_tasks(spark):
    r = random.Random(6)
    for top in (1, 3, 700):
        rows = [("g", i, r.randint(0, top), r.random() < 0.01) for i in range(4000)] + [("h", 0, 5, False), (None, 0, 5, False)]
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            df = batching.greedy(spark.createDataFrame(rows, "g string, i int, tokens int, alone boolean"), ["g"], ["i"], "tokens", "alone")
            got = df.withColumn("task", F.spark_partition_id()).orderBy("i").collect()
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        one = [x for x in got if x.g == "g"]
        assert [x.batch for x in one] == greedy([x[2] for x in rows[:4000]], [x[3] for x in rows[:4000]], batching.BATCH)
        assert len({x.task for x in one}) > 2 and [x.batch for x in got if x.g != "g"] == [1, 1]


def test_batch_example(spark):
    rows = [(1, 400, False), (2, 500, False), (3, 300, False), (4, 900, True), (5, 50, False)]
    got = batching.greedy(spark.createDataFrame([("f", *r) for r in rows], "f string, i int, tokens int, alone boolean"), ["f"], ["i"], "tokens", "alone")
    assert [r.batch for r in got.orderBy("i").collect()] == [1, 1, 2, 3, 4]


def test_ancestor_context_stops_at_the_first_overflow(spark):
    pairs = spark.createDataFrame([("n", 1, "near", 200), ("n", 2, "mid", 150), ("n", 3, "far", 50), ("m", 1, "b", 100), ("m", 2, "a", 100), ("m", 3, "", 900)], "node_id string, distance int, context string, tokens int")
    got = {r.node_id: r.context for r in batching.ancestor_context(pairs).collect()}
    assert got == {"n": "[CONTEXT]\nnear\n[/CONTEXT]\n", "m": "[CONTEXT]\na\n---\nb\n[/CONTEXT]\n"}


def test_closure_of_a_cycle_and_upsert_twice(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), (None, "a")], "src string, dst string")
    assert {(r.src, r.dst): r.distance for r in graph.closure(e, cycles=True).collect()} == {(x, y): (ord(y) - ord(x) - 1) % 3 + 1 for x in "abc" for y in "abc"}
    old = spark.createDataFrame([(1, "x", "ddl"), (2, "", "user")], "k int, description string, source string")
    new = spark.createDataFrame([(1, "y", "guess"), (2, "z", "guess"), (3, "w", "guess")], "k int, description string, source string")
    rules = {"description": graph.fill_blank("description"), "source": graph.source_priority()}
    once = graph.upsert(old, new, ["k"], rules)
    want = {(1, "x", "ddl"), (2, "z", "guess"), (3, "w", "guess")}
    assert {tuple(r) for r in once.collect()} == want == {tuple(r) for r in graph.upsert(once, new, ["k"], rules).collect()}
    assert graph.is_unique(once, ["k"])
    assert {r.k for r in graph.create_missing(old, new, ["k"]).collect()} == {1, 2, 3}


def test_a_long_path_is_walked_in_few_rounds(spark):
    n = 1500
    e = spark.createDataFrame([(i, i + 1) for i in range(n)], "src long, dst long")
    assert {(r.src, r.dst): r.distance for r in graph.closure(e.where("src < 60")).collect()} == {(a, b): b - a for a in range(60) for b in range(a + 1, 61)}
    nodes = spark.range(n + 1).select(F.col("id").alias("node_id"), (F.col("id") != 700).alias("ok"))
    assert {r.node_id: r.depth for r in graph.depths(nodes, e).collect()} == {i: i for i in range(n + 1)}
    assert {r.node_id: r.subtree_ok for r in graph.all_descendants_ok(nodes, e).collect()} == {i: i > 700 for i in range(n + 1)}


def test_walks_of_other_graphs(spark):
    loop = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    for walk in (graph.closure, lambda e: graph.depths(nodes, e).collect()):
        nodes = spark.createDataFrame([("a",)], "node_id string")
        with pytest.raises(ValueError):
            walk(loop)
    two = spark.createDataFrame([("a", "c"), ("b", "c"), ("a", "b"), ("c", "d"), (None, "d"), ("d", "d")], "src string, dst string")
    assert {tuple(r) for r in graph.closure(two.where("src <> dst")).collect()} == {("a", "c", 1), ("b", "c", 1), ("a", "b", 1), ("c", "d", 1), ("a", "d", 2), ("b", "d", 2)}
    facts = spark.createDataFrame([("d", "x"), ("c", "y"), ("d", "x")], "node_id string, fact string")
    assert {tuple(r) for r in graph.gather_up(facts, two).collect()} == {(n, f) for n in "abc" for f in "xy"} | {("d", "x")}
    assert {tuple(r) for r in graph.gather_up(facts, loop).collect()} == {("d", "x")} | {(n, "y") for n in "abc"}


def test_first_contexts_and_least_values(spark):
    uses = spark.createDataFrame([("u", "t", o, i % 40, f"c{i % 40}") for i in range(400) for o in ("r", "w")] + [(None, "t", None, None, None)], "unit string, table_name string, operation string, line int, context string")
    assert {tuple(r) for r in reports.table_usage(uses).collect()} == {("u", "t", "r,w", 800, "c0,c1,c2,c3,c4"), (None, "t", "", 1, "")}
    df = spark.createDataFrame([(i % 90 - 5, f"v{i:03}", None, float(i)) for i in range(600)], "a int, b string, c int, d double").repartition(5)
    got = {(r.column_name, r.family, r.value) for r in fk.least_values(df, ["a", "b", "c", "d"], 3).collect()}
    assert got == {("a", "number", f"{x}.0") for x in (-5, -4, -3)} | {("b", "text", f"v00{x}") for x in range(3)} | {("d", "number", f"{x}.0") for x in range(3)}


def test_what_patterns_need():
    assert detect.describe(r"\bBEGIN\b[\s\S]*\bEND\s*;") == "begin end" and detect.describe(r":=\s*") == ":="


def test_texts_as_tokens_and_as_json(spark):
    import public_tokenizers

    df = spark.createDataFrame([("select a",), ("",), (None,), ('{"a": [1]}',)], "t string")
    count = N.token_counter(public_tokenizers.path("byte_bpe_50k.json"))
    assert [r.n for r in df.select(count(F.col("t")).alias("n")).collect()][1:3] == [0, 0]
    assert [r.j for r in df.select(F.to_json(N.parse_maybe(F.col("t"))).alias("j")).collect()] == ['"select a"', '""', None, '{"a":[1]}']


def test_names_by_their_ends_and_columns_by_their_definitions(spark):
    columns = spark.createDataFrame([("s", "Orders", "Id", 0), ("s", "my_orders", "x", 0), ("t", "Orders", "Id", 0)], "schema_name string, table_name string, column_name string, ordinal int")
    at = lambda *x: {(r.schema_name, r.table_name) for r in schema.list_columns(columns, *x).collect()}
    assert at("S.orders") == {("s", "Orders")} and at("orders") == {("s", "Orders"), ("s", "my_orders"), ("t", "Orders")} and at("Orders", "t") == {("t", "Orders")} and at("nothing") == set()
    known = spark.createDataFrame([("S", "T", "ID"), ("S", "T", "id"), ("S", "T", "Name")], "schema_name string, table_name string, column_name string")
    used = spark.createDataFrame([("s", "t", "ID"), ("s", "t", "id"), ("s", "t", "iD"), ("s", "t", "NAME"), ("s", "t", "other"), (None, "t", "ID")], "schema_name string, table_name string, column_name string")
    assert [r.column_name for r in schema.column_uses(used, known).orderBy("column_name").collect()] == ["ID", "ID", "ID", "Name", "id", "other"]


def test_spans_positions_and_last_lines(spark):
    nodes = spark.createDataFrame([("d", "f", 1, 3, 1, 2), ("d", "f", 2, 3, 4, 9), ("d", "f", 3, None, 1, 9)], "directory string, file string, node_id int, parent_id int, start_line int, end_line int")
    results = spark.createDataFrame([("d", "f", 4, 9, "x"), ("d", "f", 4, 8, "y")], "directory string, file string, start_line int, end_line int, text string")
    assert [(r.node_id, r.text) for r in trees.by_span(nodes, results).collect()] == [(2, "x")]
    assert [(r.node_id, r.last_line) for r in trees.last_lines(nodes).collect()] == [(3, 9)]
    a, b = spark.createDataFrame([("g", 0, "a"), ("g", 1, "b")], "g string, pos int, x string"), spark.createDataFrame([("g", 0, "A"), ("g", 2, "C")], "g string, pos int, y string")
    assert [(r.x, r.y) for r in trees.positional(a, b, ["g"]).collect()] == [("a", "A")]


def test_views_have_stable_ids(spark):
    nodes = graph.nodes_view({"T": (spark.createDataFrame([(1, None)], "a int, b string"), ["a", "b"])})
    assert nodes.first().node_id == graph.nodes_view({"T": (spark.createDataFrame([(1, None)], "a int, b string"), ["a", "b"])}).first().node_id
    edges = graph.edges_view(spark.createDataFrame([("a", "b", "X", 1)], "src string, dst string, type string, n int"))
    assert edges.first().props == '{"n":1}'


def tree(spark, content=X.TREE, strategy="dbms"):
    return trees.flatten(spark.createDataFrame([("d", "f", content), ("d", "bad", "{"), ("d", "list", "[1]"), ("d", "none", None)], "directory string, file string, content string"), strategy)


def test_tree_code_styles(spark):
    n = tree(spark)
    code = lambda style, **k: {r.node_id: r.code for r in trees.folded_code(n, style, **k).collect()}
    assert code("skeleton")[4] == "1: CREATE PROCEDURE P_LOAD\n    ....\n9: END;"
    assert code("placeholder")[4] == "1: CREATE PROCEDURE P_LOAD\n2: ...code...\n4: ...code...\n9: END;"
    assert code("placeholder", preserve=("IF",))[4].count("...code...") == 1
    said = spark.createDataFrame([("d", "f", 3, " adds ")], "directory string, file string, node_id int, summary string")
    assert code("compact", summaries=said)[4] == "1: CREATE PROCEDURE P_LOAD\n2: IS v INT;\n3: BEGIN\n4~8: adds\n9: END;"


def test_lines_without_numbers(spark):
    n = spark.createDataFrame([("d", "f", 1, 7, "x\r\n\ny\n10: z\nw\nv")], "directory string, file string, node_id int, start_line int, code string")
    assert [(r.line_no, r.text) for r in trees.code_lines(n).orderBy("pos").collect()] == [(7, "x"), (8, "y"), (10, "z"), (11, "w"), (12, "v")]


def test_class_tree_edges(spark):
    content = '{"type":"FILE","startLine":1,"endLine":9,"children":[{"type":"CLASS","name":"A","startLine":1,"endLine":9,"code":"class A","children":[{"type":"FIELD","startLine":2,"endLine":2},{"type":"METHOD","startLine":3,"endLine":4,"children":[{"type":"NEW_INSTANCE","startLine":4,"endLine":4}]}]}]}'
    got = {(r.src, r.dst, r.type) for r in trees.edges(tree(spark, content, "framework"), "framework").collect()}
    assert got == {(5, 4, "CONTAINS"), (4, 1, "HAS_FIELD"), (4, 3, "HAS_METHOD"), (3, 2, "PARENT_OF")}


def test_nested_begin_is_no_unit(spark):
    content = '{"type":"FILE","children":[{"type":"BEGIN","children":[{"type":"BEGIN","children":[]}]}]}'
    assert {r.node_id: r.unit_id for r in tree(spark, content).collect()} == {1: 2, 2: 2, 3: None}


def test_ddl_rules(spark):
    texts = spark.createDataFrame([*X.DDL, ("c.sql", "CREATE TABLE items (\n a int,\n FOREIGN KEY (a) REFERENCES b (c)\n);"), ("long.sql", "COMMENT ON TABLE items IS '" + "it''s " * 20_000 + "';")], "file string, content string")
    cols = ddl.columns(texts)
    assert {r.column_name for r in cols.where("table_name = 'items'").collect()} == {"a"}  # the last definition holds
    assert "FOREIGN" in {r.column_name for r in ddl.columns(texts, strict=True).where("table_name = 'items'").collect()}
    assert len(ddl.tables(texts).where("table_name = 'items'").first().description) == 5 * 20_000
    assert [r.schema_name for r in ddl.schemas(texts).collect()] == ["SALES", "public"]
    assert {r.table_name for r in ddl.tables(texts, case="lowercase").collect()} == {"orders", "items", "customers"}


def test_lineage_targets_are_no_sources(spark):
    out = lineage.analyse(lineage.procedures(spark.createDataFrame(X.SQL, "file string, content string")))
    assert all(not set(r.source_tables) & set(r.target_tables) for r in out.collect())
    known = spark.createDataFrame([("dw", "fact_sales"), ("x", "ORDERS"), ("y", "orders")], "schema_name string, table_name string")
    assert {(r.src_table, r.dst_table) for r in lineage.matched(lineage.edges(out), known).collect()} == {("x.ORDERS", "dw.fact_sales"), ("y.orders", "dw.fact_sales")}


def test_detection_of_known_files(spark):
    got = {r.file: r for r in detect.detect(spark.createDataFrame(X.FILES, "file string, content string")).collect()}
    assert (got["A.java"].file_type, round(got["A.java"].confidence, 4)) == ("java", 0.6)
    assert [got[f].file_type for f in ("B.java", "c.py", "d.xml", "blank.sql", "x.sql", "y", "pg.sql", "load.sql")] == ["java", "python", "xml", "unknown", "sql_generic", "unknown", "postgresql_sp", "oracle_sp"]
    assert got["blank.sql"].confidence == 0 and got["y"].suggested_strategy == "framework"


def test_providers_read_classes(spark):
    code = "public class A extends B implements C, D<E> {\n  private List<Order> orders = new ArrayList<>();\n  final Customer customer;\n  public static Invoice bill(Order o, int n) throws X { return customer.pay(o); }\n}"
    u = spark.createDataFrame([("A", code)], "unit_id string, code string")
    assert {(r.to_type, r.relation) for r in providers.inheritance(u).collect()} == {("B", "EXTENDS"), ("C", "IMPLEMENTS"), ("D", "IMPLEMENTS")}
    f = providers.fields(u)
    assert {(r.name, r.target_class, r.relation, r.multiplicity) for r in f.collect()} == {("orders", "Order", "COMPOSITION", "*"), ("customer", "Customer", "ASSOCIATION", "1")}
    m = providers.methods(u)
    r = m.first()
    assert (r.name, r.return_type, r.visibility, r.is_static, [(p.type, p.name, p['index']) for p in r.parameters]) == ("bill", "Invoice", "public", True, [("Order", "o", 0), ("int", "n", 1)])
    deps = providers.new_dependencies(providers.dependencies(m), f)
    assert {(x.target_class, x.usage) for x in deps.collect()} == {("Invoice", "return")}
    assert [(x.target_class, x.method) for x in providers.method_calls(u, f).collect()] == [("Customer", "pay")]


def test_providers_read_procedures(spark):
    code = "1: PROCEDURE p IS\n2:   v_n NUMBER(10) := 3;\n3:   d orders.id%TYPE;\n4: BEGIN\n5:   SELECT 1 FROM orders o JOIN items i ON o.id = i.order_id; -- FROM comment\n6:   pkg.run(1);\n7: END;"
    u = spark.createDataFrame([("p", code)], "unit_id string, code string")
    assert {(r.name, r.type, r.value) for r in providers.variables(u).collect()} == {("v_n", "NUMBER(10)", "3"), ("d", "orders.id%TYPE", None)}
    assert {r.callee for r in providers.calls(u).collect()} == {"pkg.run"}
    assert [tuple(r)[1:] for r in providers.join_keys(u).collect()] == [("orders", "id", "items", "order_id")]
    assert providers.summary(u).first().summary == "reads items, orders; calls pkg.run"


def test_calls_and_descriptions(spark):
    units = spark.createDataFrame([("d", "f", "u1", "run"), ("d", "g", "u2", "pkg.go")], "directory string, file string, node_id string, name string")
    calls = spark.createDataFrame([("d", "f", "s1", "run"), ("d", "g", "s2", "run"), ("d", "f", "s3", "PKG.go"), ("d", "f", "s4", "no.where")], "directory string, file string, src string, callee string")
    got = {r.src: (r.dst, r.scope, r.is_new) for r in schema.resolve_calls(calls, units).collect()}
    assert got["s1"] == ("u1", "internal", False) and "s2" not in got and got["s3"] == ("u2", "external", False) and got["s4"][1:] == ("external", True)
    df = spark.createDataFrame([("a", None, None), ("b", "x", "ddl")], "t string, description string, description_source string")
    assert schema.describe(df, {"t": "zz"}, "new")[1] == 0 and schema.describe(df, {"t": "a"}, "new")[1] == 1


def plain_fold(code, start, kids, style):
    """A node's lines with its children's folded, line by line; kids: (start, id, end, shown), shown None: kept."""
    import re

    lines, out, last, before = [x for x in code.replace("\r\n", "\n").split("\n") if x != ""], [], None, None
    for pos, x in enumerate(lines):
        m = re.match(r"(\d{1,9}):", x)
        if m:
            last = (pos, int(m[1]))
        no = last[1] + pos - last[0] if last else start + pos
        text = re.match(r"\d+:\s?([^\n\r\u0085\u2028\u2029]*)", x)[1] if m else x
        kid = next((k for k in sorted(kids) if k[0] <= no <= k[2]), None)
        if kid is None or (kid[3] is None and style != "skeleton"):
            out.append(f"{no}: {text}")
        elif (before is None) if style == "skeleton" else before is not kid:
            out.append("    ...." if style == "skeleton" else kid[3])
        before = kid
    return "\n".join(out)


def test_parsing_folds_code_as_line_by_line(spark):
    """parsing cuts codes at their children's lines, and what comes of it is what a plain version gives, line by line."""
    r, nodes, said, want = random.Random(5), [], [], {"skeleton": {}, "compact": {}}
    for k in range(400):
        first, n = r.choice((1, 7, 95, 998)), r.randrange(1, 12)
        lines = [f"{first + i}: " + r.choice(("x", "", " y", "a: b", "\u00e9")) for i in range(n)]
        for _ in range(r.choice((0, 0, 0, 1, 2))):
            i = r.randrange(n)
            lines[i] = r.choice(("", "z", f"0{first + i}: z", f"{first + i}:z", f"{first + i}:\tz", f"{first + i + 5}: z", f"{first + i}: z\u2028w", f"{first + i}: z\r"))
        code, at, kids = "\n".join(lines), first, []
        while r.random() < 0.7 and at < first + n:
            s = at + r.choice((0, 0, 1, 2))
            e = s + r.choice((0, 1, 2, 2, -1))
            kids.append((s, len(kids) + 1, e))
            at = e + r.choice((1, 1, 1, 0, 2))
        f = f"f{k}"
        nodes.append(("d", f, 99, None, "IF", first, first + n - 1, code, bool(kids)))
        nodes += [("d", f, c, 99, "SELECT", s, e, "", False) for s, c, e in kids]
        shown = [(s, c, e, r.choice((f"sum {c}", f"sum {c}", None))) for s, c, e in kids]
        said += [("d", f, c, t) for _, c, _, t in shown if t]
        want["skeleton"][f] = plain_fold(code, first, [(*x[:3], "") for x in shown], "skeleton")
        want["compact"][f] = plain_fold(code, first, [(s, c, e, t and f"{s}~{e}: {t}") for s, c, e, t in shown], "compact")
    def tree(own):
        return {"type": "IF", "startLine": own[5], "endLine": own[6], "code": own[7], "children": [{"type": "SELECT", "startLine": x[5], "endLine": x[6]} for x in nodes if x[1] == own[1] and x[3]]}

    files = spark.createDataFrame([("d", x[1], json.dumps(tree(x))) for x in nodes if x[3] is None and x[8]], "directory string, file string, content string")
    rows = trees.flatten(files, columns=("directory", "file", "node_id", "parent_id", "kind", "start_line", "end_line", "code", "has_children", "runs", "frame"))
    texts = spark.createDataFrame(said, "directory string, file string, node_id int, summary string")
    top, below = rows.where("parent_id IS NULL"), rows.where("parent_id IS NOT NULL").join(texts, ["directory", "file", "node_id"], "left")
    frames = {x.file: x.frame for x in top.collect()}
    assert {f: x or "" for f, x in frames.items()} == {f: x for f, x in want["skeleton"].items() if f in frames} and len(frames) > 100
    assert {x.file: x.code for x in trees.folded_runs(top, below).collect()} == {f: x for f, x in want["compact"].items() if f in frames}
    slow = {x.file: x.code for x in trees.folded_code(top, "compact", inner=below, every=True).collect()}
    assert slow == {f: x for f, x in want["compact"].items() if f in frames}


def test_all_texts_are_ranked(spark):
    """the nearest text is found wherever its name stands, and rows without a vector aren't."""
    tables = spark.range(1000).select(F.lit("").alias("schema_name"), F.lpad(F.col("id").cast("string"), 4, "0").alias("table_name"), F.when(F.col("id") == 987, "quick zebra").when(F.col("id") % 10 > 0, F.concat(F.lit("blue part "), F.col("id").cast("string"))).alias("description"))
    found = vectors.search_text(tables, "quick zebra", 3, candidates=None).collect()
    assert (found[0].table_name, found[0].similarity) == ("0987", 1.0)
    df = spark.createDataFrame([(f"a{i}", [1.0, float(i)]) for i in range(300)] + [("b", []), ("c", None)], "table_name string, vector array<float>")
    got = vectors.search(df, F.array(F.lit(0.0), F.lit(1.0)), 400, candidates=None, least=-1.0).collect()
    assert len(got) == 300 and got[0].table_name == "a100" and [r.similarity for r in got] == sorted((r.similarity for r in got), reverse=True)


def test_texts(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    assert get(N.token_estimate(F.lit("a1 b; "))) == 4 and get(N.token_estimate(F.lit(""))) == 0
    assert get(N.access_modes(F.lit("rw"))) == ["FROM", "WRITES"] and get(N.access_modes(F.lit(None).cast("string"))) == []
    assert get(N.full_directory(F.lit("a\\b/"), F.lit("c"))) == "a/b/c" and get(N.embedding_text(F.lit(" "), F.lit(None).cast("string"))) == "empty"
    assert get(N.description_text(F.lit("d"), F.lit("x"))).endswith("x") and get(N.class_name(F.lit("INTERFACE"), F.lit("public interface I {"))) == "I"
    assert get(N.now_iso()).endswith("Z") and get(N.blank(F.lit(" N/A "))) is True


def test_vectors(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", None), ("d", [0.6, 0.8])], "table_name string, vector array<float>")
    assert [(r.table_name, r.similarity) for r in vectors.search(df, F.array(F.lit(1.0), F.lit(0.0))).collect()] == [("a", 1.0), ("d", 0.6)]
    filled = vectors.vectorise(df, F.col("table_name"))
    assert filled.where("size(vector) = 64").count() == 1 and vectors.vectorise(df, F.col("table_name"), missing_only=False, limit=2).where("size(vector) = 64").count() == 2


def test_glossary_changes(spark):
    g = spark.createDataFrame(X.GLOSSARIES, "glossary_id int, name string, type string")
    t = spark.createDataFrame(X.TERMS, "term_id int, glossary_id int, name string, description string, status string")
    links = spark.createDataFrame(X.LINKS, "term_id int, type string, target string")
    assert glossary.put(g, {"glossary_id": 9, "name": "New", "type": None}, "glossary_id").count() == 4
    assert glossary.put(t, {"term_id": 2, "status": "Approved"}, "term_id").where("term_id = 2").first().name == "Customer"
    assert {r.target for r in glossary.put_links(links, 1, "HAS_TAG", ["z"]).where("term_id = 1").collect()} == {"Commerce", "Ann", "z"}
    left = glossary.delete_glossary(g, t, links, 1)
    assert [x.count() for x in left] == [2, 1, 0] and glossary.delete_term(t, links, 1)[2] == 1
    assert [r.term_id for r in glossary.list_terms(t, links, search="BUY").collect()] == [1] and glossary.list_terms(t, links, status="Draft").count() == 2


def test_stories_and_reports(spark):
    units = spark.createDataFrame([("u", "Unit", "does"), ("v", "None", None)], "unit_id string, name string, summary string")
    found = spark.createDataFrame([("u", "US-1", "clerk", "see", "sell")], "unit_id string, story_id string, role string, goal string, benefit string")
    acs = spark.createDataFrame([("u", "US-1", "AC-1", "t", ["g"], ["w"], ["n"]), ("v", "US-1", "AC-9", "other", [], [], [])], "unit_id string, story_id string, criterion_id string, title string, given array<string>, when array<string>, then array<string>")
    nested = reports.stories(units, found, acs)
    assert [tuple(r) for r in reports.story_totals(nested).collect()] == [(1, 1)]
    assert reports.markdown(nested).first().text == "## Unit\ndoes\n### US-1\n- As clerk, I want see, so that sell\n#### AC-1 t\n- Given g\n- When w\n- Then n"
    usage = reports.table_usage(spark.createDataFrame([("u", "t<", "r", 1, "c")], "unit string, table_name string, operation string, line int, context string"))
    assert "<td>t&lt;</td>" in reports.html(usage).first().html


def test_search_hints(spark):
    message = 'column "region" does not exist. Perhaps you meant to reference the column "t"."area".'
    assert spark.range(1).select(search.error_hints(F.lit(message)).alias("x")).first().x == ["region", "t.area"]
    values = spark.createDataFrame([("Seoul",), ("Busan",), (None,)], "v string")
    assert [tuple(r) for r in search.by_prefix(values, "seoulxyz", "v").collect()] == [("Seoul", "seoul")] and search.by_prefix(values, "zz", "v").count() == 0
    terms = spark.createDataFrame([("SEOUL",), ("Buzan",), ("x",)], "term string")
    assert {tuple(r) for r in search.map_values(terms, values.select(F.col("v").alias("value"))).collect()} == {("SEOUL", "Seoul", "SIMILAR"), ("Buzan", "Busan", "SIMILAR")}


def test_values_are_mapped_whatever_their_first_letter(spark):
    values = ["standard anodized tin", "small plated brass", "Xenon", "orders", "total_amount", "amount_total", "b", None]
    terms = ["xstandard anodized tin", "mall plated brass", "xtandard anodized tin", "rders", "Zenon", "amount total", "b", "c", ""]
    v, t = spark.createDataFrame([(x,) for x in values], "value string"), spark.createDataFrame([(x,) for x in terms], "term string")
    got = {tuple(r) for r in search.map_values(t, v, measure=S.levenshtein_similarity(F.col("a"), F.col("b"))).collect()}
    similar = {("xstandard anodized tin", "standard anodized tin"), ("xtandard anodized tin", "standard anodized tin"), ("mall plated brass", "small plated brass"), ("rders", "orders"), ("Zenon", "Xenon"), ("amount total", "amount_total")}
    assert got == {(*x, "SIMILAR") for x in similar} | {("b", "b", "EXACT")}
    # matching blocks against every pair
    ratio = lambda x, y: SequenceMatcher(None, x.lower(), y.lower()).ratio()
    want = {}
    for x in terms:
        best = min((-ratio(x, y), y) for y in values if y)
        if x != "b" and -best[0] >= search.VALUE:
            want[x] = best[1]
    assert {(r.term, r.value) for r in search.map_values(t, v).where("kind = 'SIMILAR'").collect()} == set(want.items()) >= {("Zenon", "Xenon"), ("rders", "orders")}


def test_only_values_that_exist_are_kept(spark):
    mapped = spark.createDataFrame([("t", "c", "x", 1), ("t", "c", "y", 2), ("t", "d", "x", 3)], "table_name string, column_name string, value string, i int")
    stored = spark.createDataFrame([("t", "c", "x")] * 50 + [("t", "d", "z")], "table_name string, column_name string, value string")
    kept, gone = search.existing(mapped, stored)
    assert [r.i for r in kept.collect()] == [1] and sorted(r.i for r in gone.collect()) == [2, 3]


@pytest.mark.parametrize(("t", "seed"), [(0.8, 1), (0.65, 2), (0.9, 3)])
def test_similar_pairs_are_all_found(spark, t, seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdé_1") for _ in range(r.choice((1, 1, 2, 2, 3, 4, 5, 8, 13, 30)))) for _ in range(60)]

    def altered(x):
        x = list(x)
        for _ in range(r.choice((0, 1, 1, 2, 4))):
            k = r.randrange(len(x) + 1)
            x[k : k + r.randint(0, 1)] = r.choice(["", "a", "bb", "Z"])
        return "".join(x)

    left = sorted({altered(r.choice(base)) for _ in range(150)} | {"", "aaaaaaaaaaaaaaaa", "AB"})
    right = sorted({altered(r.choice(base)).upper() for _ in range(150)} | {"", "aaaaaaaaaaaa", "ab"})
    a, b = spark.createDataFrame([(x,) for x in [*left, None, left[5]]], "a string"), spark.createDataFrame([(x,) for x in [*right, None]], "b string")
    ratio = lambda x, y: SequenceMatcher(None, x.lower(), y.lower()).ratio()
    want = {(x, y) for x in left for y in right if x and y and ratio(x, y) >= t}
    assert {(p.a, p.b) for p in similar.similar(a, b, t).collect()} == want and want
    near = {(p.a, p.b) for p in similar.candidates(a, b, t).collect()}
    assert {(x, y) for x in left for y in right if x and y and S.indel(x.lower(), y.lower()) >= t} <= near


def test_candidates_of_part_names_are_few(spark, sf):
    names = spark.read.parquet(f"{sf}/part.parquet").select("p_name").distinct()
    texts = [x.p_name for x in names.collect() if x.p_name]
    terms = [x[1:] + "x" for x in texts]
    a, b = spark.createDataFrame([(x,) for x in terms], "a string"), names.withColumnRenamed("p_name", "b")
    ratio = lambda x, y: SequenceMatcher(None, x.lower(), y.lower()).ratio()
    want = {(x, y) for x in terms for y in texts if ratio(x, y) >= 0.8}
    assert {(p.a, p.b) for p in similar.similar(a, b, 0.8).collect()} == want
    assert len(want) <= similar.candidates(a, b, 0.8).count() < len(terms) * len(texts) / 4


def test_similar_column_names_are_those_of_all_pairs(spark):
    names = ["id", "ID", "user_id", "userid", "user id", "created_at", "created", "updated_at", "o_custkey", "c_custkey", "custkey", "customer_key", "x", "xy", "name", "full name", "name full", "amount_total", "total_amount", ""]
    columns = spark.createDataFrame([("s", f"t{i % 5}", n, "int") for i, n in enumerate(names)] + [("s", "t9", "id", "bigint")], "schema_name string, table_name string, column_name string, data_type string")
    rows = [tuple(x) for x in columns.collect()]
    score = lambda x, y: 0.5 * S.indel(x.lower(), y.lower()) + 0.5 * S.weighted(x.lower(), y.lower())
    for threshold in (0.8, 0.7, 0.6):
        want = {(x[1], x[2], y[1], y[2]) for x in rows for y in rows if x[1] < y[1] and x[2] and y[2] and score(x[2], y[2]) >= threshold}
        got = {(x.from_table_name, x.from_column_name, x.to_table_name, x.to_column_name) for x in fk.candidates(columns, threshold=threshold).collect()}
        assert got == want


def test_needed_words_are_those_of_the_patterns():
    sre, parser = pytest.importorskip("re._constants"), pytest.importorskip("re._parser")

    def walk(ops):
        out, run = [], ""
        for op, value in ops:
            if op is sre.LITERAL:
                run += chr(value)
                continue
            if run:
                out, run = [*out, (run.lower(),)], ""
            if op is sre.SUBPATTERN:
                out += walk(value[3])
            elif op is sre.MAX_REPEAT and value[0]:
                out += walk(value[2])
            elif op is sre.BRANCH:
                each = [max((x for x in walk(w) if len(x) == 1), key=lambda x: len(x[0]), default=None) for w in value[1]]
                out += [tuple(x[0] for x in each)] if all(each) else []
        return [*out, (run.lower(),)] if run else out

    assert walk(parser.parse(r"CREATE\s+(OR\s+REPLACE\s+)?VIEW\s+\w+")) == [("create",), ("view",)] and walk(parser.parse(r"\b(A|BC)\s*\(x?")) == [("a", "bc"), ("(",)]
    assert NEEDED == {p: walk(parser.parse(p)) for p, _ in detect._ALL}


def test_fields_made_with_new_and_assignments_below(spark):
    fields = spark.createDataFrame([("new", None), (None, "ASSOCIATION"), ("call", None)], "value_source string, association_type string")
    assert [r[0] for r in fields.select(trees.composition(fields)).collect()] == ["COMPOSITION", "ASSOCIATION", "ASSOCIATION"]
    nodes = spark.createDataFrame([("d", "f", 1, "ASSIGNMENT"), ("d", "f", 2, "IF"), ("d", "f", 3, "NEW_INSTANCE"), ("d", "g", 1, "IF")], "directory string, file string, node_id int, kind string")
    pairs = spark.createDataFrame([("d", "f", 2, 1), ("d", "f", 4, 1), ("d", "f", 4, 3), ("d", "g", 4, 1), ("d", "f", 4, 2)], "directory string, file string, src int, dst int")
    assert {(r.node_id, r.found) for r in trees.assignments_below(nodes, pairs).collect()} == {(2, 1), (4, 1), (4, 3)}


def test_tags_have_a_colour(spark):
    tags = spark.createDataFrame([("b", None), ("a", "red")], "name string, color string")
    assert [(r.name, r.color) for r in glossary.named(tags).collect()] == [("a", "red"), ("b", glossary.COLOR)]
    assert [r.name for r in glossary.named(tags.drop("color")).collect()] == ["a", "b"]


def test_edges_and_depths_stand_in_the_rows(spark):
    """a deep tree's edges, depths and chosen columns come from one pass, without a shuffle."""
    deep = {"type": "FILE", "children": [{"type": "IF", "name": 7, "startLine": "3"}, {"type": "PROCEDURE", "children": []}]}
    at = deep["children"][1]
    for i in range(200):
        at["children"] = [{"type": "IF", "startLine": i, "children": []}, {"type": "UPDATE"}]
        at = at["children"][0]
    df = spark.createDataFrame([("d", "f", json.dumps(deep)), ("d", "g", "{"), ("d", "h", json.dumps(deep))], "directory string, file string, content string")
    nodes = trees.flatten(df, columns=("directory", "file", "node_id", "parent_id", "kind", "name", "start_line", "depth", "height", "parent_kind", "next_id", "above"))
    plan = trees.edges(trees.by_depth(nodes))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1
    rows = [r for r in nodes.where("file = 'h'").collect()]
    up, by = {r.node_id: r.parent_id for r in rows}, {r.node_id: r for r in rows}
    for r in rows:
        chain, x = [], r.node_id
        while up[x] is not None:
            chain.append(up[x])
            x = up[x]
        parents = set(up.values())
        assert (r.depth, r.above) == (len(chain), chain[: trees.ABOVE] if r.node_id in parents else None)
    assert max(r.height for r in rows) == by[len(rows)].height == 202 - 1 and (by[1].name, by[1].start_line) == ("7", 3)
    got = {(r.src, r.dst, r.type) for r in trees.edges(nodes).where("file = 'f'").collect()}
    root = len(rows)
    assert {x for x in got if root in x[:2]} == {(root, 1, "CONTAINS"), (root, root - 1, "CONTAINS")} and (1, root - 1, "NEXT") in got and len(got) == root - 1 + 1 + 200


def test_lines_stay_in_their_node(spark):
    """codes are folded in the node's row; only children meet parents, and lines without numbers are counted on."""
    n = 60
    lines = [f"{i}: x" if i % 3 else "y" for i in range(2, 2 + 3 * n)]
    kids = [{"type": "IF", "startLine": 2 + 3 * i, "endLine": 3 + 3 * i, "code": f"{2 + 3 * i}: x"} for i in range(n)]
    content = json.dumps({"type": "PROCEDURE", "startLine": 1, "endLine": 3 * n + 2, "code": "1: P\r\n" + "\n\n".join(lines), "children": kids})
    nodes = trees.flatten(spark.createDataFrame([("d", "f", content)], "directory string, file string, content string"))
    got = {s: {r.node_id: r.code for r in trees.folded_code(nodes, s).collect()} for s in ("skeleton", "placeholder")}
    kept = [4 + 3 * i for i in range(n)]
    assert got["skeleton"][n + 1] == "1: P\n" + "\n".join(f"    ....\n{k}: x" if k % 3 else f"    ....\n{k}: y" for k in kept)
    assert got["placeholder"][n + 1] == "1: P\n" + "\n".join(f"{k - 2}: ...code...\n{k}: {'x' if k % 3 else 'y'}" for k in kept)
    plan = trees.folded_code(nodes)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and len(got["skeleton"]) == n + 1


def test_only_ranked_texts_are_embedded(spark):
    """the first candidates by name are taken before texts are embedded, and a text's hashes are made once."""
    tables = spark.range(1000).select(F.lit("").alias("schema_name"), F.lpad(F.col("id").cast("string"), 4, "0").alias("table_name"), F.concat(F.lit("blue part "), F.col("id").cast("string")).alias("description"))
    found = vectors.search_text(tables, "blue part 7", 3)
    assert [r.table_name for r in found.collect()][0] == "0007" and found.count() == 3
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    lowest = max(i for i, x in enumerate(plan) if "Sort [table_name" in x)
    assert any("md5" in x for x in plan) and not any("md5" in x for x in plan[lowest + 1 :])
