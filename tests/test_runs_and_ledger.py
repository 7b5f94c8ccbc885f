"""Stateful streams of runs, the ledger of a run's files, and jobs that can be ended."""

import random
import threading
import time
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tracewright.sources import tables
from tracewright.streaming import events, ledger, runs

EVENTS = "run_id string, seq long, type string, content string, phase double, ts timestamp"
START = datetime(2024, 5, 1)


def plain_runs(rows, late, idle, asking):
    """One run after the other, event by event."""
    newest = max(r[5] for r in rows)
    out = []
    for run in sorted({r[0] for r in rows}):
        no, last, limit, closed = 0, None, idle, False
        for _, seq, kind, content, phase, ts in sorted((r for r in rows if r[0] == run), key=lambda r: r[1]):
            if last is not None and ts - last > timedelta(seconds=limit):
                out += [(run, no + 1, None, "error", f"TimeoutError: {limit} s"), (run, no + 2, None, "complete", None)]
                closed = True
                break
            last = ts
            if kind == "complete":
                out.append((run, no + 1, None, "complete", None))
                closed = True
                break
            no += 1
            out.append((run, no, seq, kind, content))
            if phase and phase >= 2:
                limit = asking
            if kind == "error":
                out.append((run, no + 1, None, "complete", None))
                closed = True
                break
        if not closed and last + timedelta(seconds=limit, milliseconds=1) <= newest - timedelta(seconds=late):
            out += [(run, no + 1, None, "error", f"TimeoutError: {limit} s"), (run, no + 2, None, "complete", None)]
    return sorted(out, key=str)


def made(seed, n=400):
    r, at, rows = random.Random(seed), START, []
    for seq in range(n):
        at += timedelta(seconds=r.choice((5, 20, 60, 90)))
        kind = r.choice(["message"] * 30 + ["error", "complete"] + ["phase_event"] * 4)
        rows.append((f"r{r.randrange(14)}", seq, kind, f"c{seq}", r.choice((1.0, 2.0)) if kind == "phase_event" else None, at))
    return rows


def collected(df):
    return sorted((tuple(r) for r in df.select("run_id", "no", "seq", "type", "content").collect()), key=str)


@pytest.mark.parametrize("seed", [1])
def test_replay_equals_batch_and_plain(spark, tmp_path, seed):
    rows = made(seed)
    want = plain_runs(rows, 60, 300, 600)
    assert {"error", "complete"} <= {x[3] for x in want} and any(str(x[4]).startswith("TimeoutError") for x in want)
    assert collected(runs.replayed(spark.createDataFrame(rows, EVENTS), 60)) == want
    # the same rows as a stream in several batches, each file later than the one before
    folder = str(tmp_path / "in")
    for k in range(0, len(rows), 100):
        spark.createDataFrame(rows[k : k + 100], EVENTS).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)
        if k in (100, 300):  # begun again from the checkpoint in between
            stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)
            runs.follow(stream, str(tmp_path / "out"), str(tmp_path / "state"), late="60 seconds").awaitTermination()
    got = collected(spark.read.schema(runs.OUT).parquet(str(tmp_path / "out")))
    assert got == want
    assert max(sum(x[0] == r and x[3] == "complete" for x in got) for r in {x[0] for x in got}) == 1
    # once more without anything new: nothing is added
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)
    runs.follow(stream, str(tmp_path / "out"), str(tmp_path / "state"), late="60 seconds").awaitTermination()
    assert collected(spark.read.schema(runs.OUT).parquet(str(tmp_path / "out"))) == want


def test_late_events_and_rows_without_a_run_are_dropped(spark, tmp_path):
    folder, at = str(tmp_path / "in"), lambda s: START + timedelta(seconds=s)
    for rows in ([("a", 1, "message", "x", None, at(0)), (None, 1, "message", "x", None, at(0)), ("b", 1, "message", "y", None, at(5000))], [("a", 2, "message", "late", None, at(100)), ("b", 2, "error", "z", None, at(5100)), ("b", 3, "message", "after", None, at(5101))]):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)
    runs.follow(stream, str(tmp_path / "out"), str(tmp_path / "state"), late="10 seconds").awaitTermination()
    got = collected(spark.read.schema(runs.OUT).parquet(str(tmp_path / "out")))
    assert got == sorted([("a", 1, 1, "message", "x"), ("a", 2, None, "error", "TimeoutError: 300 s"), ("a", 3, None, "complete", None), ("b", 1, 1, "message", "y"), ("b", 2, 2, "error", "z"), ("b", 3, None, "complete", None)], key=str)


def named(spark, n):
    return spark.range(n).select(F.lit("d").alias("directory"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("file"), F.col("id").alias("size"))


def test_a_second_run_does_what_is_pending(spark, tmp_path):
    files, book, control = named(spark, 40), ledger.Ledger(spark, str(tmp_path / "ledger")), events.Control()
    assert book.pending(files, 1).count() == 40 and book.state(files.limit(0)).count() == 0
    seen, lock = [], threading.Lock()

    def work(part):
        names = {r.file for r in part.select("file").collect()}
        if "f7" in names:
            raise OSError("broken")
        with lock:
            seen.extend(names)

    with pytest.raises(OSError, match="broken"):
        ledger.run_phase(book, control, 1, files, work, parts=4, workers=1)
    state = {r.file: r.status for r in book.state(files).collect()}
    assert state["f7"] == "PH1_FAIL" and {f for f, s in state.items() if s == "PH1_OK"} == set(seen)
    assert [r.message for r in book.state(files).where("file = 'f7'").collect()] == ["OSError: broken"]
    # phase 2 is for what went well; the rest is skipped when the run ends there
    assert {r.file for r in book.pending(files, 2).collect()} == set(seen)
    before = set(seen)
    again = []
    ledger.run_phase(ledger.Ledger(spark, str(tmp_path / "ledger")), events.Control(), 1, files, lambda part: again.extend(r.file for r in part.collect()), parts=4)
    assert before | set(again) == {f"f{i}" for i in range(40)} and not before & set(again)
    assert book.pending(files, 1).count() == 0 and ledger.run_phase(book, control, 1, files, work) == 0
    assert ledger.run_phase(book, control, 2, files, lambda part: None, parts=3) > 0
    assert {r.status for r in book.state(files).collect()} == {"PH2_OK"}


def test_what_failed_before_is_skipped_and_other_parts_go_on(spark, tmp_path):
    files, book = named(spark, 12), ledger.Ledger(spark, str(tmp_path / "ledger"))

    def work(part):
        if part.where("file = 'f3'").count():
            raise ValueError("no")

    ledger.run_phase(book, events.Control(), 1, files, work, parts=6, strict=False)
    book.skip(files, 2)
    state = {r.file: r.status for r in book.state(files).collect()}
    assert state["f3"] == "SKIPPED" and set(state.values()) == {"SKIPPED", "PH1_OK"}


def slow(batches):
    for b in batches:
        time.sleep(120)
        yield pa.RecordBatch.from_pydict({"x": b.column(0)})


def test_stop_ends_running_jobs(spark, tmp_path):
    files, book, control = named(spark, 6), ledger.Ledger(spark, str(tmp_path / "ledger")), events.Control()
    begun, result = threading.Event(), []

    def work(part):
        begun.set()
        part.select(F.col("size").alias("x")).mapInArrow(slow, "x long").count()

    def run():
        try:
            ledger.run_phase(book, control, 1, files, work, parts=2)
        except BaseException as e:
            result.append(e)

    t = threading.Thread(target=run)
    t.start()
    assert begun.wait(60)
    time.sleep(3)
    at = time.time()
    control.stop(spark=spark)
    t.join(30)
    assert not t.is_alive() and time.time() - at < 15 and isinstance(result[0], events.Stopped)
    assert {r.status for r in book.state(files).collect()} == {"PENDING"}  # neither done nor failed
    with pytest.raises(events.Stopped):
        ledger.run_phase(book, control, 1, files, lambda part: None)
    assert ledger.run_phase(book, events.Control(), 1, files, lambda part: None, parts=2) > 0 and book.pending(files, 1).count() == 0


def test_the_first_failure_ends_the_other_jobs(spark, tmp_path):
    files, book = named(spark, 40), ledger.Ledger(spark, str(tmp_path / "ledger"))
    begun = threading.Event()

    def work(part):
        if part.where("file = 'f0'").count():
            begun.wait(30)
            time.sleep(2)
            raise OSError("first")
        begun.set()
        part.select(F.col("size").alias("x")).mapInArrow(slow, "x long").count()

    at = time.time()
    with pytest.raises(OSError, match="first"):
        ledger.run_phase(book, events.Control(), 1, files, work, parts=3, workers=3)
    assert time.time() - at < 60 and book.state(files).where("file = 'f0'").first().status == "PH1_FAIL"


def test_a_table_that_is_not_whole_does_not_count(spark, tmp_path):
    book = ledger.Ledger(spark, str(tmp_path / "ledger"))
    book.append(named(spark, 2), 1, ledger.ok(1))
    (half,) = tables.children(spark, book.path)
    tables.delete(spark, f"{book.path}/{half}/_SUCCESS")
    assert book.rows().count() == 0 and book.pending(named(spark, 2), 1).count() == 2


def test_a_run_costs_three_calls_of_its_state():
    """rows come and go as rows, and a new run reads its state once, sets one timer and writes once; an event without seq stands last."""
    calls = []

    class Fake:
        def __getattr__(self, name):
            return lambda *a: calls.append(name)

        def getValueState(self, *_):  # noqa: N802
            return self

    class Now:
        def getCurrentWatermarkInMs(self):  # noqa: N802
            return 0

    e = runs.Ending(300, 600, 86400)
    e.init(Fake())
    row = Row("run_id", "seq", "type", "content", "phase", "ms")
    given = [row("a", None, "message", "z", None, 3000), row("a", 2, "message", "y", 2.0, 2000), row("a", 1, "message", "x", None, 1000)]
    assert [tuple(r) for r in e.handleInputRows(("a",), iter(given), Now())] == [("a", 1, 1, "message", "x"), ("a", 2, 2, "message", "y"), ("a", 3, None, "message", "z")]
    assert calls == ["get", "registerTimer", "update"]


def test_runs_that_share_a_key_read_their_states_once():
    """many runs cost one reading, one timer and one writing; each goes on, ends and is forgotten as by itself."""
    calls, held = [], []

    class Fake:
        def __getattr__(self, name):
            return lambda *a: calls.append((name, *a))

        def getValueState(self, *_):  # noqa: N802
            return self

        def get(self):
            calls.append(("get",))
            return held[-1] if held else None

        def update(self, value):
            calls.append(("update",))
            held.append(value)

        def clear(self):
            calls.append(("clear",))
            held.clear()

    class Now:
        def __init__(self, mark):
            self.mark = mark

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return self.mark

    e = runs.Endings(300, 600, 86400)
    e.init(Fake())
    given = [Row("key", "run_id", "seq", "type", "content", "phase", "ms", "ts")(7, f"r{k}", s, t, "c", 2.0 if k == 1 else None, 1000 * s, None) for k in range(500) for s, t in ((2, "error" if k == 2 else "message"), (1, "message"))]
    out = [tuple(r) for r in e.handleInputRows((7,), iter(given), Now(0))]
    assert len(out) == 1001 and [x[1:4] for x in out if x[0] == "r2"] == [(1, 1, "message"), (2, 2, "error"), (3, None, "complete")]
    assert calls == [("get",), ("registerTimer", 302001), ("update",)]
    timed = [tuple(r) for r in e.handleExpiredTimer((7,), Now(400000), None)]
    assert len(timed) == 2 * 498 and not {"r1", "r2"} & {x[0] for x in timed} and calls[-2][:2] == ("registerTimer", 602001)
    late = [Row("key", "run_id", "seq", "type", "content", "phase", "ms", "ts")(7, r, 9, "message", "c", None, 500000, None) for r in ("r1", "r2", "r3")]
    assert [tuple(r)[:3] for r in e.handleInputRows((7,), iter(late), Now(400000))] == [("r1", 3, 9)]
    assert len(list(e.handleExpiredTimer((7,), Now(10**9), None))) == 2 and [held[-1][0], list(held[-1][3])] == [["r1"], [600]]


@pytest.mark.parametrize("shared", [None, 3])
def test_streams_with_and_without_shared_keys(spark, tmp_path, shared):
    rows = made(2, 200)
    for k in (0, 100):
        spark.createDataFrame(rows[k : k + 100], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    runs.follow(stream, str(tmp_path / "out"), str(tmp_path / "state"), late="60 seconds", shared=shared).awaitTermination()
    assert collected(spark.read.schema(runs.OUT).parquet(str(tmp_path / "out"))) == plain_runs(rows, 60, 300, 600)
