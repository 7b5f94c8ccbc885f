"""The incremental graph store, provider answers, and waves from the leaves up."""

import hashlib
import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from tracewright import generated
from tracewright.operators import batching, graph, trees, vectors
from tracewright.plans import summaries, waves
from tracewright.sources import answers, store, tables


def nodes(spark, rows):
    return spark.createDataFrame(rows, "node_id string, labels array<string>, props string")


def edges(spark, rows):
    return spark.createDataFrame(rows, "edge_id string, src string, dst string, type string, props string")


def content(pair):
    n, e = pair
    return sorted((r.node_id, tuple(r.labels), r.props) for r in n.collect()), sorted(tuple(r) for r in e.collect())


FIRST = ([("a", ["Table"], '{"name":"t","n":1}'), ("b", ["Column"], '{"name":"c"}'), ("b", ["Column", "Key"], '{"name":"c","z":null}')], [("e", "a", "b", "HAS", "{}")])
SECOND = ([("a", ["Table", "Seen"], '{"n":2.5,"name":null,"d":{"x":[1]}}'), ("c", ["Column"], None), (None, ["Column"], "{}")], [("e", "a", "b", "HAS", '{"w":1}'), ("f", "a", "c", "HAS", "{}")])


def test_two_merges_are_one(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "g"), buckets=4)
    assert content(s.read()) == ([], [])
    s.merge(nodes(spark, FIRST[0]), edges(spark, FIRST[1]))
    m = s.merge(nodes(spark, SECOND[0]), edges(spark, SECOND[1]))
    want = ([("a", ("Table", "Seen"), '{"d":{"x":[1]},"n":2.5,"name":"t"}'), ("b", ("Column", "Key"), '{"name":"c","z":null}'), ("c", ("Column",), "{}")], [("e", "a", "b", "HAS", '{"w":1}'), ("f", "a", "c", "HAS", "{}")])
    assert content(s.read()) == want and m.version == 2
    assert content((m.nodes, m.edges)) == want  # every node is touched: b as an end of an edge
    assert content(s.read(1))[0] == [("a", ("Table",), '{"n":1,"name":"t"}'), ("b", ("Column", "Key"), '{"name":"c","z":null}')]
    again = store.Store(spark, str(tmp_path / "h"), buckets=4)
    again.merge(nodes(spark, FIRST[0]), edges(spark, FIRST[1]))
    again.merge(nodes(spark, SECOND[0]), edges(spark, SECOND[1]))
    again.merge(nodes(spark, SECOND[0]), edges(spark, SECOND[1]))  # once more changes nothing
    assert content(again.read()) == want
    assert s.vacuum() > 0 and content(s.read()) == want and store.Store(spark, str(tmp_path / "g")).buckets == 4


def test_untouched_partitions_keep_their_files(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "g"), buckets=8)
    many = spark.range(400).select(F.col("id").cast("string").alias("node_id"), F.array(F.lit("T")).alias("labels"), F.lit("{}").alias("props"))
    s.merge(many, edges(spark, []))
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(tmp_path / "g" / "data") for f in names if f.endswith(".parquet")}
    before, old = files(), s._manifest(1)["parts"]
    m = s.merge(nodes(spark, [("7", ["T"], '{"x":1}')]), edges(spark, []))
    assert len(m.rewritten) == 1 and len(old) == 8
    assert {k: v for k, v in files().items() if k in before} == before
    now = s._manifest(2)["parts"]
    assert sum(now[k] != old[k] for k in old) == 1 and s.read()[0].count() == 400 and m.nodes.count() == 1


def test_a_reader_between_two_merges_sees_a_whole_state(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "g"), buckets=2)
    s.merge(nodes(spark, FIRST[0]), edges(spark, FIRST[1]))
    reader = s.read()  # planned before the merge, run after it
    s.merge(nodes(spark, SECOND[0]), edges(spark, SECOND[1]))
    assert len(content(reader)[0]) == 2 and len(content(s.read())[0]) == 3


def test_of_two_merges_at_once_one_starts_again(spark, tmp_path, monkeypatch):
    a, b = (store.Store(spark, str(tmp_path / "g"), buckets=2) for _ in range(2))
    write = store.write_new

    def late(session, path, text):
        monkeypatch.setattr(store, "write_new", write)
        b.merge(nodes(spark, SECOND[0]), edges(spark, []))
        return write(session, path, text)

    monkeypatch.setattr(store, "write_new", late)
    with pytest.raises(store.Conflict):
        a.merge(nodes(spark, FIRST[0]), edges(spark, FIRST[1]))
    assert {r.node_id for r in a.read()[0].collect()} == {"a", "c"}
    a.merge(nodes(spark, FIRST[0]), edges(spark, FIRST[1]))
    assert {r.node_id for r in a.read()[0].collect()} == {"a", "b", "c"}


def test_unique_keys_hold(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "g"), buckets=4, unique={"Table": ["schema", "name"]})
    t = lambda i, schema, name, label="Table": (i, [label], f'{{"schema":{schema},"name":"{name}"}}')
    m = s.merge(nodes(spark, [t("1", '"s"', "a"), t("2", '"s"', "a"), t("3", "null", "a"), t("4", "null", "a"), t("5", '"s"', "a", "View")]), edges(spark, []))
    assert {(r.node_id, r.holder) for r in m.rejected.collect()} == {("2", "1")} and {r.node_id for r in s.read()[0].collect()} == {"1", "3", "4", "5"}
    m = s.merge(nodes(spark, [t("0", '"s"', "a"), t("1", '"s"', "a"), t("6", '"s"', "b")]), edges(spark, []))
    assert {(r.node_id, r.holder) for r in m.rejected.collect()} == {("0", "1")}
    assert {r.node_id for r in s.read()[0].collect()} == {"1", "3", "4", "5", "6"}
    assert {(r.node_id, r.version) for r in s.rejected().collect()} == {("2", 1), ("0", 2)}


def test_a_hot_id_is_put_together(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "g"), buckets=2)
    hot = spark.range(3000).select(F.lit("hot").alias("node_id"), F.array(F.lit("T")).alias("labels"), F.concat(F.lit('{"v":'), F.lpad((F.col("id") + 1000).cast("string"), 4, "0"), F.lit("}")).alias("props"))
    s.merge(hot, edges(spark, []))
    assert content(s.read())[0] == [("hot", ("T",), '{"v":3999}')]


def counted(folder):
    """A provider that notes each prompt that it is asked."""

    def provider(prompts):
        for p in prompts:
            with open(f"{folder}/{hashlib.md5(p.encode()).hexdigest()}", "a") as f:
                f.write("x")
        return [f"said {p}" for p in prompts]

    return provider


def asked(folder):
    return {f: len(open(f"{folder}/{f}").read()) for f in os.listdir(folder)}


def test_each_prompt_is_asked_once(spark, tmp_path):
    (tmp_path / "seen").mkdir()
    provider, kept = counted(str(tmp_path / "seen")), str(tmp_path / "store")
    rows = spark.createDataFrame([(i, f"p{i % 120}" if i % 7 else None, "old") for i in range(900)], "i int, prompt string, answer string")
    got = answers.ask(rows, provider, kept)
    assert all(r.answer == (f"said {r.prompt}" if r.prompt else None) and r.error is None for r in got.collect()) and got.count() == 900
    assert set(asked(tmp_path / "seen").values()) == {1} and len(asked(tmp_path / "seen")) == 120
    more = rows.union(spark.createDataFrame([(1000, "new", "")], "i int, prompt string, answer string"))
    assert answers.ask(more, provider, kept).where("answer IS NOT NULL").count() == got.where("answer IS NOT NULL").count() + 1
    assert set(asked(tmp_path / "seen").values()) == {1} and len(asked(tmp_path / "seen")) == 121
    assert answers.ask(rows.limit(0), provider, kept).count() == 0


def test_failures_are_tried_again_and_named(spark, tmp_path):
    (tmp_path / "seen").mkdir()
    folder = str(tmp_path / "seen")

    def provider(prompts):
        tried = os.path.join(folder, "tries")
        with open(tried, "a") as f:
            f.write("x")
        if "bad" in prompts or len(open(tried).read()) < 2:
            raise OSError("away")
        return prompts

    one = lambda *p: spark.createDataFrame([(x,) for x in p], "prompt string").coalesce(1)
    assert [r.answer for r in answers.ask(one("good"), provider, str(tmp_path / "a")).collect()] == ["good"]
    (r,) = answers.ask(one("bad"), provider, str(tmp_path / "a")).collect()
    assert r.answer is None and r.error == "OSError: away" and answers.stored(spark, str(tmp_path / "a")).count() == 1
    (r,) = answers.ask(one("two"), lambda p: [], str(tmp_path / "b"), attempts=1).collect()
    assert "0 answers to 1 prompts" in r.error
    with pytest.raises(Exception, match="away"):
        answers.ask(one("bad"), provider, str(tmp_path / "c"), attempts=1, strict=True)


def test_heights(spark):
    links = [("r", "a"), ("r", "b"), ("a", "c"), ("c", "d"), ("d", "e"), ("b", "f")] + [(f"n{i}", f"n{i + 1}") for i in range(200)]
    e = spark.createDataFrame(links, "src string, dst string")
    n = e.select(F.col("src").alias("node_id")).union(e.select("dst")).distinct().union(spark.createDataFrame([("alone",)], "node_id string"))
    got = {r.node_id: r.height for r in graph.heights(n, e).collect()}
    assert {k: got[k] for k in "rabcdef"} == {"r": 4, "a": 3, "b": 1, "c": 2, "d": 1, "e": 0, "f": 0} and got["alone"] == 0
    assert all(got[f"n{i}"] == 200 - i for i in range(201))
    with pytest.raises(ValueError, match="cycle"):
        graph.heights(n, spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string"))


def parsed(spark, sf, orders=6):
    files = generated.deep_trees(spark, sf).orderBy(F.length("file"), "file").limit(orders)
    return tables.cut(trees.flags(trees.flatten(files)), "parsed")


def test_waves_go_on_where_they_were_ended(spark, sf, tmp_path):
    (tmp_path / "seen").mkdir()
    n, folder = parsed(spark, sf), str(tmp_path / "seen")
    note = counted(folder)

    def ended(prompts):
        if any("IF" in p for p in prompts):
            raise KeyboardInterrupt  # not an error of the provider: the task dies
        return note(prompts)

    with pytest.raises(Exception):  # noqa: B017, PT011
        waves.analyse(n, ended, str(tmp_path / "run"), strict=True)
    first = asked(folder)
    assert first and tables.exists(spark, f"{tmp_path}/run/results/wave=0/_SUCCESS") and not tables.exists(spark, f"{tmp_path}/run/results/wave=1/_SUCCESS")
    out = waves.analyse(n, note, str(tmp_path / "run")).collect()
    assert {k: v for k, v in asked(folder).items() if k in first} == first and set(asked(folder).values()) == {1}
    assert len(out) == n.where("analysable").count() and all(r.ok for r in out)
    by = {(r.file, r.node_id): r for r in out}
    whole = waves.analyse(n, lambda p: [f"said {x}" for x in p], str(tmp_path / "other")).collect()
    assert {(r.file, r.node_id): r.summary for r in whole} == {k: r.summary for k, r in by.items()}
    branch = by[whole[0].file, 3]
    assert branch.prompt.split("\n")[1] == f"4~5: said {by[branch.file, 1].prompt}".split("\n")[0]
    before = asked(folder)
    assert waves.analyse(n, note, str(tmp_path / "run")).count() == len(out) and asked(folder) == before


def test_failures_climb_in_waves(spark, sf, tmp_path):
    n = parsed(spark, sf)
    some = n.where("kind = 'UPDATE'").orderBy("file", "node_id").first()

    def provider(prompts):
        if any(p.startswith(some.code[:20]) and p == some.code for p in prompts):
            raise OSError("no")
        return ["s"] * len(prompts)

    out = {(r.file, r.node_id): r for r in waves.analyse(n, provider, str(tmp_path / "run"), batch=1).collect()}
    bad = {k for k, r in out.items() if not r.ok}
    failed = {k for k, r in out.items() if r.error}
    assert (some.file, some.node_id) in failed and len(failed) < 5 and all(out[k].summary is None for k in failed)
    rows = {(r.file, r.node_id): r.parent_id for r in n.collect()}
    above = set()
    for f, i in failed:
        while rows[f, i] is not None:
            i = rows[f, i]
            above.add((f, i))
    assert bad == failed | {k for k in above if k in out}
    assert waves.analyse(n.limit(0), provider, str(tmp_path / "none")).count() == 0


def test_stores_do_not_mix(spark, tmp_path):
    done = []

    def one(k):
        s = store.Store(spark, str(tmp_path / f"g{k}"), buckets=2)
        s.merge(nodes(spark, [(f"n{k}", ["T"], "{}")]), edges(spark, []))
        done.append({r.node_id for r in s.read()[0].collect()} == {f"n{k}"})

    threads = [threading.Thread(target=one, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert done == [True] * 3


def test_vectors_come_from_a_provider_once(spark, tmp_path):
    (tmp_path / "seen").mkdir()
    note = counted(str(tmp_path / "seen"))

    def provider(texts):
        if "bad" in texts:
            raise OSError("no vector")
        note(texts)
        return [f"[{len(t)}, 0.5]" for t in texts]

    rows = spark.createDataFrame([(1, "one", None, 7), (2, "one", None, 7), (3, "two", [9.0], 7), (4, " ", None, 7), (5, None, None, 7), (6, "three", [], 7)], "i int, t string, vector array<float>, prompt int")
    got = {r.i: r.vector for r in vectors.vectorise_by(rows, F.col("t"), provider, str(tmp_path / "store")).collect()}
    assert {r.prompt for r in vectors.vectorise_by(rows, F.col("t"), provider, str(tmp_path / "store")).collect()} == {7}
    assert got == {1: [3.0, 0.5], 2: [3.0, 0.5], 3: [9.0], 4: None, 5: None, 6: [5.0, 0.5]}
    assert list(asked(tmp_path / "seen").values()) == [1, 1]
    more = rows.union(spark.createDataFrame([(7, "bad", None, 7)], rows.schema))
    again = {r.i: (r.vector, r.error) for r in vectors.vectorise_by(more, F.col("t"), provider, str(tmp_path / "store")).collect()}
    assert again[1] == ([3.0, 0.5], None) and again[7] == (None, "OSError: no vector") and list(asked(tmp_path / "seen").values()) == [1, 1]


def test_waves_take_heights_from_the_rows(spark, sf, tmp_path, monkeypatch):
    """parsed nodes know their heights, so no tree is walked before the first wave."""
    monkeypatch.setattr(graph, "heights", lambda *_: pytest.fail("walked"))
    n = parsed(spark, sf)
    out = waves.analyse(n, lambda p: ["s"] * len(p), str(tmp_path / "run")).collect()
    assert len(out) == n.where("analysable").count() > 0 and all(r.ok and r.summary == "s" for r in out)
    assert not [x for x in tables.children(spark, tables.shared_dir(spark)) if x.startswith("prompts-")]


def test_contexts_come_from_the_rows_and_deep_ones_from_walks(spark, sf, monkeypatch):
    """shallow files are not walked; deep ones are, and both give the contexts that walks give."""
    deep = {"type": "UPDATE", "startLine": 99, "endLine": 99, "code": "99: UPDATE T"}
    for i in range(70):
        deep = {"type": "LOOP" if i % 2 else "IF", "startLine": 99 - i, "endLine": 99 + i, "code": f"{99 - i}: FROM t{i}\n99: UPDATE T" if i % 5 else "", "children": [deep]}
    files = generated.deep_trees(spark, sf).orderBy(F.length("file"), "file").limit(4)
    files = files.union(spark.createDataFrame([("d", "deep", json.dumps({"type": "FILE", "children": [deep]}))], files.schema))
    n = tables.cut(trees.flags(trees.flatten(files)), "parsed")
    edges = n.where("parent_id IS NOT NULL").select(summaries.key("parent_id").alias("src"), summaries.key().alias("dst"))
    want = batching.contexts_above(edges, summaries.parent_contexts(n).select(summaries.key().alias("node_id"), "context", "tokens"))
    want = {r.node_id: r.context for r in want.join(n.where("analysable").select(summaries.key().alias("node_id")), "node_id", "left_semi").collect()}
    assert {r.unit_id: r.context for r in summaries.contexts(n).collect()} == want and len(want) > 70
    monkeypatch.setattr(batching, "contexts_above", lambda *_: pytest.fail("walked"))
    assert summaries.contexts(n.where("file <> 'deep'")).count() == len(want) - 70


def test_contexts_of_frames_fold_nothing(spark, sf, monkeypatch):
    """parsing gives the frames of nodes with children, so no lines meet their children, and contexts are the same."""
    files = generated.deep_trees(spark, sf).orderBy(F.length("file"), "file").limit(6)
    columns = ("directory", "file", "node_id", "parent_id", "kind", "name", "start_line", "end_line", "has_children", "depth", "above")
    want, n = (tables.cut(trees.flags(trees.flatten(files, columns=(*columns, c))), "parsed") for c in ("code", "frame"))
    said = {(r.file, r.node_id): r.context for r in summaries.node_contexts(want).collect()}
    monkeypatch.setattr(trees, "folded_code", lambda *_, **__: pytest.fail("folded"))
    assert {(r.file, r.node_id): r.context for r in summaries.node_contexts(n).collect()} == said and len(said) > 20


def test_waves_of_runs_fold_nothing(spark, sf, tmp_path, monkeypatch):
    """parsing cuts codes at their children's lines, and children are found in their results; an ended wave leaves no prompts."""
    files = generated.deep_trees(spark, sf).orderBy(F.length("file"), "file").limit(6)
    of = lambda *more: trees.flags(trees.flatten(files, columns=("directory", "file", "node_id", "parent_id", "kind", "start_line", "end_line", "code", "has_children", "height", "parent_height", *more)))
    rule = lambda p: [x[:9] if "IF 2" not in x else "" for x in p]
    want = {tuple(r) for r in waves.analyse(of(), rule, str(tmp_path / "codes")).collect()}
    monkeypatch.setattr(trees, "folded_code", lambda *_, **__: pytest.fail("folded"))
    assert {tuple(r) for r in waves.analyse(of("runs"), rule, str(tmp_path / "runs")).collect()} == want and len(want) > 20
    left = lambda: [x for x in tables.children(spark, tables.shared_dir(spark)) if x.startswith("prompts-")]
    before = left()
    with pytest.raises(Exception):  # noqa: B017, PT011
        waves.analyse(of("runs"), lambda p: 1 / 0, str(tmp_path / "ended"), strict=True)
    assert left() == before
    again = waves.analyse(of(), rule, str(tmp_path / "ended"))  # begun with runs
    assert {tuple(r) for r in again.collect()} == want
