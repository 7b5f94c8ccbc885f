import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from tracewright.sources import files, tables
from tracewright.streaming import events


def test_source_folders(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "x.sql").write_bytes(b"\xef\xbb\xbfSELECT '\xff'")
    (tmp_path / "a" / "b" / "y.SQL").write_text("z")
    (tmp_path / "a" / "p.sql.json").write_text("{}")
    (tmp_path / "a" / "q.json").write_text("{}")
    folder = str(tmp_path)
    assert sorted((r.directory, r.file) for r in files.sql_files(spark, folder).collect()) == [("", "x.sql"), ("a/b", "y.SQL")]
    assert files.sql_files(spark, folder).where("file = 'x.sql'").first().content.startswith("SELECT")
    assert sorted((r.directory, r.file) for r in files.parsed_files(spark, folder).collect()) == [("a", "p.sql"), ("a", "q.sql")]
    assert [r.file for r in files.ddl_files(spark, folder).collect()] == ["x.sql"]
    assert files.ddl_files(spark, folder + "/none").count() == 0 and not files.has_files(spark, folder + "/none") and files.has_files(spark, folder)


def test_exports_audit_and_cache(spark, tmp_path):
    path = tmp_path / "e.json"
    path.write_text("﻿" + json.dumps([{"procedure_name": "p", "procedure_start_line": 1, "node_type": "X", "node1": {"labels": ["A"], "properties": {"k": "v\tw"}}}, {"procedure_name": None}]))
    groups = files.export_groups(files.export_records(spark, str(path))).collect()
    assert len(groups) == 1 and groups[0].records[0].node1.properties == {"k": "v\tw"}
    files.write_audit(spark.createDataFrame([("r", None, 2), ("s", 1.0, 9), ("t", None, None)], "rule string, sort_key double, start_line int"), str(tmp_path / "audit"))
    assert [r.rule for r in files.read_audit(spark, str(tmp_path / "audit")).collect()] == ["s", "r", "t"]
    asked = spark.createDataFrame([("r", "a"), ("r", "b")], "rule string, prompt string")
    cache = asked.limit(1).select(F.sha2(F.concat_ws("\u0001", "rule", "prompt"), 256).alias("prompt_hash"), F.lit("{}").alias("response"))
    known, missing = files.cached_responses(asked, cache)
    assert known.count() == 1 and missing.count() == 1


def test_ndjson_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "message", "hi"), (2, "noise", "x"), (3, "complete", None)], "seq long, type string, content string")
    rows.write.json(str(tmp_path / "in"))
    events.stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"type":"complete"}', '{"type":"message","content":"hi"}']


def test_runs_end_once(spark):
    rows = spark.createDataFrame([("a", 1, "message"), ("a", 2, "complete"), ("b", 1, "error"), ("b", 2, "message")], "run_id string, seq long, type string")
    assert sorted((r.run_id, r.seq, r.type) for r in events.closed(rows).collect()) == [("a", 1, "message"), ("a", 2, "complete"), ("b", 1, "error"), ("b", 2, "complete")]


def test_control(spark):
    c = events.Control()
    c.enter(events.Phase.DDL)
    c.progress = 140
    c.pause()
    assert c.status() == {"phase": "ddl", "paused": True, "stopped": False, "progress": 100}
    c.stop()
    with pytest.raises(events.Stopped):
        c.check()
    with pytest.raises(RuntimeError):
        events.fail_fast(spark.createDataFrame([(1, False)], "b int, ok boolean"))


def test_intermediate_tables_are_written_and_deleted(spark, tmp_path):
    a = tables.cut(spark.range(5), "a")
    b = tables.cut(a.where("id > 1"), "b", after=a)
    assert b.count() == 3 and not tables._PATHS.get(a)
    with tables.passing(spark):
        c = tables.cut(spark.range(3), "c")
        path = tables._PATHS[c]
        c.write.parquet(str(tmp_path / "kept"))
    assert not os.path.exists(path) and spark.read.parquet(str(tmp_path / "kept")).count() == 3 and b.count() == 3


def test_a_cluster_must_name_its_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://somewhere:7077"})()  # noqa: N815

    with pytest.raises(ValueError):
        tables.shared_dir(Session())


def test_prompt_rules(tmp_path):
    (tmp_path / "r.yaml").write_text("name: r\nprompt: |\n  say {x}\n")
    assert files.rule(tmp_path, "r").startswith("name: r")
    pytest.importorskip("yaml")
    assert files.parsed_rule(tmp_path, "r") == {"name": "r", "prompt": "say {x}\n"}


def test_scopes_of_threads_keep_apart(spark):
    kept, deleted = [], []

    def outer():
        with tables.passing(spark):
            a = tables.cut(spark.range(3), "a")
            inside.set()
            done.wait(60)
            kept.append(a.count())
        deleted.append(True)

    inside, done = threading.Event(), threading.Event()
    t = threading.Thread(target=outer)
    t.start()
    assert inside.wait(60)
    with tables.passing(spark):
        tables.cut(spark.range(5), "b")
    done.set()
    t.join()
    assert kept == [3] and deleted == [True]
