"""Walks that stop at a budget or a frontier, folds that keep a bounded number of rows, nearest vectors."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import batching, bounded, graph, reports, schema, vectors
from tracewright.plans import providers


def forest(seed, n=120):
    r = random.Random(seed)
    parent = {i: r.randrange(max(0, i - 6), i) if i and r.random() < 0.95 else None for i in range(n)}
    return parent, [(f"n{p}", f"n{i}") for i, p in parent.items() if p is not None]


def above(parent, i):
    out = []
    while parent[i] is not None:
        i = parent[i]
        out.append(i)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_reached_is_what_stands_above_or_below(spark, seed):
    parent, links = forest(seed)
    edges = spark.createDataFrame(links, "src string, dst string")
    start = spark.createDataFrame([("n5",), ("n90",), ("n90",), ("n117",), ("gone",), (None,)], "node_id string")
    up = {(r.start, r.node) for r in graph.reached(edges, start).collect()}
    assert up == {(f"n{i}", f"n{a}") for i in (5, 90, 117) for a in above(parent, i)}
    down = {(r.start, r.node) for r in graph.reached(edges, start, up=False).collect()}
    assert down == {(f"n{i}", f"n{j}") for i in (5, 90, 117) for j in parent if i in above(parent, j)}


@pytest.mark.parametrize("seed", [1, 2])
def test_contexts_within_a_budget(spark, seed):
    parent, links = forest(seed)
    r = random.Random(seed)
    texts = {i: (f"c{i}", r.randint(1, 9)) if r.random() < 0.6 else (r.choice(["", None]), 5) for i in parent}
    edges = spark.createDataFrame(links, "src string, dst string")
    contexts = spark.createDataFrame([(f"n{i}", c, t) for i, (c, t) in texts.items()], "node_id string, context string, tokens int")
    want = {}
    for i in parent:
        used, total = [], 0
        for a in above(parent, i):
            if texts[a][0]:
                total += texts[a][1]
                if total > 20:
                    break
                used.append(texts[a][0])
        if used:
            want[f"n{i}"] = "[CONTEXT]\n" + "\n---\n".join(reversed(used)) + "\n[/CONTEXT]\n"
    assert {x.node_id: x.context for x in batching.contexts_above(edges, contexts, 20).collect()} == want


def test_a_very_deep_chain_takes_few_rounds(spark):
    n = 100_000
    edges = spark.range(n).select(F.col("id").cast("string").alias("src"), (F.col("id") + 1).cast("string").alias("dst"))
    contexts = spark.range(0, n, 50).select(F.col("id").cast("string").alias("node_id"), F.lit("c").alias("context"), F.lit(100).alias("tokens"))
    at = time.time()
    got = batching.contexts_above(edges, contexts, 300)
    assert got.where("node_id = '99999'").first().context.count("c\n") == 3 and got.count() == n
    assert time.time() - at < 240


def test_statements_and_references_walk_what_is_asked_for(spark):
    nodes = spark.createDataFrame([("p", "PROCEDURE", "P", 1), ("a", "IF", None, 2), ("b", "UPDATE", None, 3), ("q", "PROCEDURE", "Q", 9), ("c", "UPDATE", None, 10)], "node_id string, kind string, name string, start_line int")
    edges = spark.createDataFrame([("p", "a"), ("a", "b"), ("q", "c")], "src string, dst string")
    assert [r.node_id for r in schema.statements(nodes, edges, "P").collect()] == ["a", "b"]
    uses = spark.createDataFrame([("b", "t", "WRITES"), ("c", "t", "FROM"), ("x", "t", "FROM"), ("c", "u", "FROM")], "src string, table_name string, type string")
    assert {(r.unit, r.statement, r.type) for r in schema.references(uses, nodes, edges, "t").collect()} == {("P", "b", "WRITES"), ("Q", "c", "FROM"), (None, "x", "FROM")}


@pytest.mark.parametrize("held", [1 << 20, 4])
def test_first_rows_are_those_of_sorting_everything(spark, monkeypatch, held):
    monkeypatch.setattr(bounded, "HELD", held)
    r = random.Random(held)
    rows = [(r.choice(["a", "b", "é", None]), r.choice([1, 2, None]), r.choice([5, 6, 7, 2**60, None]), r.choice(["x", "Z", "", None, "é", "\U0001f600"])) for _ in range(500)]
    df = spark.createDataFrame(rows, "k string, l int, o long, p string").repartition(3)
    first = lambda x: tuple((v is not None, v.encode() if isinstance(v, str) else v or 0) for v in x)
    want = {}
    for row in sorted(set(rows), key=lambda x: first(x[2:])):
        want.setdefault(row[:2], []).append(row[2:])
    got = {}
    for x in bounded.first_rows(df, ["k", "l"], ["o", "p"], 4).collect():
        got.setdefault((x.k, x.l), []).append((x.o, x.p))
    assert {k: sorted(v, key=first) for k, v in got.items()} == {k: v[:4] for k, v in want.items()}


def test_one_group_of_all_rows(spark):
    uses = spark.range(200_000).select(F.lit("u").alias("unit"), F.lit("t").alias("table_name"), F.lit("r").alias("operation"), (F.col("id") % 50_000).alias("line"), (F.col("id") % 50_000).cast("string").alias("context"))
    (x,) = reports.table_usage(uses).collect()
    assert x.occurrences == 200_000 and x.contexts == "0,1,2,3,4"
    rows = spark.range(100_000).select(F.lit("s").alias("schema_name"), F.lit("t").alias("table_name"), F.lit("c").alias("column_name"), F.col("id").alias("seq"), F.lpad(F.col("id").cast("string"), 6, "0").alias("description"), F.lit("int").alias("dtype"), F.lit(True).alias("nullable"), F.lpad((F.col("id") % 9).cast("string"), 2, "0").alias("example"))
    (x,) = schema.summarise_uses(rows).collect()
    assert len(x.descriptions) == schema.DESCRIPTIONS and x.descriptions[-1] == "000099" and x.examples == ["00", "01", "02", "03", "04"] and x.dtype == "int"
    many = spark.range(30_000).select(F.lit("s").alias("schema_name"), F.lit("t").alias("table_name"), F.concat(F.lit("u"), F.lpad((F.col("id") % 300).cast("string"), 3, "0")).alias("unit"), F.when(F.col("id") % 2 == 0, "FROM").otherwise("WRITES").alias("type"))
    (x,) = providers.table_descriptions(many).collect()
    assert x.text.startswith("read by u000, u002, ") and " and 130 more; written by u001" in x.text


def test_nearest_vectors_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 40)
    r = np.random.default_rng(3)
    stored = [(i, [float(x) for x in np.round(r.normal(size=6), 1)]) for i in range(300)] + [(400 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(30)]
    stored += [(500, None), (501, []), (502, [0.0] * 6), (503, [float("nan")] * 6), (504, [None] * 6), (505, [1.0, 2.0])]
    asked = [(i, [float(x) for x in np.round(r.normal(size=6), 1)]) for i in range(90)] + [(100, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]), (101, None), (102, [2.0, 4.0])]
    want = {}
    for q, v in asked:
        if v:
            near = [(-round(float(np.dot(v, x) / np.linalg.norm(v) / np.linalg.norm(x)), 9), k) for k, x in stored if x and len(x) == len(v) and None not in x and any(x) and not any(np.isnan(x))]
            want[q] = [k for _, k in sorted(near)[:7]]
    kind = "vector array<double>"
    got = {}
    for x in vectors.top_k(spark.createDataFrame(asked, f"question_id long, {kind}"), spark.createDataFrame(stored, f"key long, {kind}"), 7).orderBy("question_id", F.desc("similarity"), "key").collect():
        got.setdefault(x.question_id, []).append(x.key)
    assert got == want and got[100] == [400 + i for i in range(7)] and got[102] == [505]
    assert vectors.top_k(spark.createDataFrame([], f"question_id long, {kind}"), spark.createDataFrame(stored, f"key long, {kind}"), 7).count() == 0
