"""Streams of runs: each run's events are passed on until it ends, and it ends once.

A run ends at its first error, at a 'complete' event, or when nothing has come from it for too long, which is an error
of its own. What ends it is followed by one 'complete' event; whatever comes later is dropped. The state of a run is a
few numbers in the state store, so a query that is started again from its checkpoint never ends a run twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds without an event after which a run has failed: in its first phase, and from the second on, when models are asked.
IDLE, IDLE_ASKING = 300, 600
#: Seconds that a run is remembered after its end.
KEEP = 7 * 86400
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

OUT = "run_id string, no long, seq long, type string, content string"
_STATE = "no long, last long, idle long, closed boolean, timer long"
_STATES = "run_id array<string>, no array<long>, last array<long>, idle array<long>, closed array<boolean>, timer array<long>"
#: Keys that share the states of all runs.
SHARED = 4096
_OUT = Row("run_id", "no", "seq", "type", "content")


def _seq(r: Row) -> tuple:
    """In the order of seq, rows without one last."""
    return (r.seq is None, r.seq or 0)


def _ending(out: list[tuple], run_id: str, no: int, error: str | None) -> int:
    """Appends what ends a run; its last number."""
    if error:
        no += 1
        out.append((run_id, no, None, "error", error))
    out.append((run_id, no + 1, None, "complete", None))
    return no + 1


def _passed(out: list[tuple], run_id: str, state: tuple, events: list[tuple], asking: int) -> tuple:
    """Appends what a run that hasn't ended passes on of events (seq, type, content, phase, ms), in order; its state without the timer."""
    no, last, idle, closed = state
    for seq, kind, content, phase, ms in events:
        if last is not None and ms - last > 1000 * idle:
            no, closed = _ending(out, run_id, no, f"TimeoutError: {idle} s"), True
            break
        last = ms if last is None else max(last, ms)
        if kind == "complete":
            no, closed = _ending(out, run_id, no, None), True
            break
        no += 1
        out.append((run_id, no, seq, kind, content))
        if phase is not None and phase >= 2:
            idle = asking
        if kind == "error":
            no, closed = _ending(out, run_id, no, None), True
            break
    return no, last, idle, closed


class Ending(StatefulProcessor):
    """The state of a run: events passed on, time of the last one in ms, seconds that it may be idle, whether it ended, its timer."""

    def __init__(self, idle: int, idle_asking: int, keep: int):
        self.idle, self.idle_asking, self.keep = idle, idle_asking, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.run = handle, handle.getValueState("run", _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        state = self.run.get()
        no, last, idle, closed, timer = state if state is not None else (0, None, self.idle, False, None)
        if closed:
            return
        mark = timerValues.getCurrentWatermarkInMs()
        every = sorted((r for r in rows if r.ms >= mark), key=_seq)  # Spark itself drops late rows one batch later
        if not every:
            return
        out: list[tuple] = []
        no, last, idle, closed = _passed(out, key[0], (no, last, idle, closed), [(r.seq, r.type, r.content, r.phase, r.ms) for r in every], self.idle_asking)
        if timer is not None:
            self.handle.deleteTimer(timer)
        # a run that has ended is forgotten later; one that goes on is looked at again when it has been idle too long
        timer = last + 1000 * (self.keep if closed else idle) + 1
        self.handle.registerTimer(timer)
        self.run.update((no, last, idle, closed, timer))
        yield from (_OUT(*x) for x in out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        no, last, idle, closed, timer = self.run.get()
        if closed:
            self.run.clear()
            return
        out: list[tuple] = []
        no = _ending(out, key[0], no, f"TimeoutError: {idle} s")
        timer = last + 1000 * self.keep + 1
        self.handle.registerTimer(timer)
        self.run.update((no, last, idle, True, timer))
        yield from (_OUT(*x) for x in out)

    def close(self) -> None:
        pass


class Endings(Ending):
    """Ending for the runs that share a key: their states are read and written together, with one timer, the first that any of them has."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.runs = handle, handle.getValueState("runs", _STATES)

    def _read(self) -> dict[str, tuple]:
        held = self.runs.get()
        return {} if held is None else {x[0]: tuple(x[1:]) for x in zip(*held, strict=True)}

    def _write(self, states: dict[str, tuple], before: int | None) -> None:
        first = min((x[-1] for x in states.values()), default=None)
        if before is not None and before != first:
            self.handle.deleteTimer(before)
        if first is not None and before != first:
            self.handle.registerTimer(first)
        if states:
            self.runs.update((list(states), *map(list, zip(*states.values(), strict=True))))
        else:
            self.runs.clear()

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        given: dict[str, list[tuple]] = {}
        for r in rows:
            _, run_id, *event, _ = r  # key, run_id, seq, type, content, phase, ms, ts
            if event[4] >= mark:
                given.setdefault(run_id, []).append(tuple(event))
        if not given:
            return
        states = self._read()
        before = min((x[-1] for x in states.values()), default=None)
        out: list[tuple] = []
        for run_id, events in given.items():
            state = states.get(run_id, (0, None, self.idle, False, None))[:4]
            if not state[3]:
                events.sort(key=lambda x: (x[0] is None, x[0] or 0))
                no, last, idle, closed = _passed(out, run_id, state, events, self.idle_asking)
                states[run_id] = (no, last, idle, closed, last + 1000 * (self.keep if closed else idle) + 1)
        self._write(states, before)
        yield from (_OUT(*x) for x in out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        mark, out, states = timerValues.getCurrentWatermarkInMs(), [], {}
        for run_id, (no, last, idle, closed, timer) in self._read().items():
            if timer > mark:
                states[run_id] = (no, last, idle, closed, timer)
            elif not closed:  # one that has ended is forgotten
                no = _ending(out, run_id, no, f"TimeoutError: {idle} s")
                states[run_id] = (no, last, idle, True, last + 1000 * self.keep + 1)
        self._write(states, None)  # the timer that has expired goes by itself
        yield from (_OUT(*x) for x in out)


def ended(events: DataFrame, late: str, idle: int = IDLE, idle_asking: int = IDLE_ASKING, keep: int = KEEP, shared: int | None = SHARED) -> DataFrame:
    """A streaming frame of OUT rows from streaming events (run_id, seq, type, content, phase, ts).

    no counts a run's rows. Events of a run within a batch are taken in the order of seq, batches as they come; events
    that are `late` behind the newest one are dropped, as are those of a run that has ended. Rows without run_id are
    dropped. phase is that of a phase event, else null. Other columns aren't carried. shared: so many keys, by a hash of
    run_id, hold the states of all runs, so a batch asks for states once a key and not once a run; None: each run is a key.
    A checkpoint goes with the number it was begun with.
    """
    rows = events.where("run_id IS NOT NULL AND ts IS NOT NULL").withColumn("ms", F.unix_millis("ts")).withWatermark("ts", late)
    rows = rows.select(F.col("run_id").cast("string"), F.col("seq").cast("long"), "type", "content", F.col("phase").cast("double"), "ms", "ts")
    if shared is None:
        return rows.groupBy("run_id").transformWithState(Ending(idle, idle_asking, keep), OUT, "Append", "EventTime")
    rows = rows.select(F.pmod(F.xxhash64("run_id"), F.lit(shared)).alias("key"), "*")
    return rows.groupBy("key").transformWithState(Endings(idle, idle_asking, keep), OUT, "Append", "EventTime")


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB, which stateful processors need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def follow(events: DataFrame, target: str, checkpoint: str, late: str, once: bool = True, **limits: int | None):
    """Starts a query that appends ended() rows to a folder of Parquet files; once: until all that is there now is read."""
    with rocks(events.sparkSession):
        writer = ended(events, late, **limits).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def replayed(events: DataFrame, late_seconds: int, idle: int = IDLE, idle_asking: int = IDLE_ASKING) -> DataFrame:
    """What follow() has written when all events have come in order: the same by windows over each run, in batch.

    A run that hasn't ended is one that the newest event of all, less late_seconds, doesn't leave behind yet.
    """
    each = events.where("run_id IS NOT NULL AND ts IS NOT NULL").select(F.col("run_id").cast("string"), F.col("seq").cast("long"), "type", "content", F.col("phase").cast("double"), F.unix_millis("ts").alias("ms"))
    mark = each.agg((F.max("ms") - 1000 * late_seconds).alias("mark"))
    w = W.partitionBy("run_id").orderBy("seq")
    asking = F.coalesce(F.max(F.col("phase") >= 2).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(False))
    each = each.withColumns({"own": F.when(asking, idle_asking).otherwise(idle), "before": F.max("ms").over(w.rowsBetween(W.unboundedPreceding, -1))})
    each = each.withColumn("slow", F.coalesce(F.col("ms") - F.col("before") > 1000 * F.col("own"), F.lit(False)))
    ends = F.col("slow") | F.col("type").isin("error", "complete")
    each = each.withColumn("ended", F.coalesce(F.max(ends).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(False))).where("NOT ended")
    passed = each.where("NOT slow AND type <> 'complete'").withColumn("no", F.row_number().over(w).cast("long"))
    after = F.when(F.coalesce(F.col("phase") >= 2, F.lit(False)), idle_asking).otherwise(F.col("own"))  # how long it may be idle after this event
    last = each.groupBy("run_id").agg(F.max_by(F.struct("type", "slow", "ms", "own", after.alias("after")), "seq").alias("x"), F.max("ms").alias("ms"), F.count_if(~F.col("slow") & (F.col("type") != "complete")).alias("n"))
    last = last.join(F.broadcast(mark))
    error = F.when(F.col("x.slow"), F.col("x.own")).when(~F.col("x.type").isin("error", "complete") & (F.col("ms") + 1000 * F.col("x.after") + 1 <= F.col("mark")), F.col("x.after"))
    done = last.withColumn("error", error).where("error IS NOT NULL OR x.type IN ('error', 'complete')")
    made = F.array(F.when(F.col("error").isNotNull(), F.struct((F.col("n") + 1).alias("no"), F.lit("error").alias("type"), F.concat(F.lit("TimeoutError: "), F.col("error"), F.lit(" s")).alias("content"))), F.struct((F.col("n") + F.when(F.col("error").isNotNull(), 2).otherwise(1)).cast("long").alias("no"), F.lit("complete").alias("type"), F.lit(None).cast("string").alias("content")))
    made = done.select("run_id", F.explode(F.filter(made, lambda x: x.isNotNull())).alias("m")).select("run_id", "m.no", F.lit(None).cast("long").alias("seq"), "m.type", "m.content")
    return passed.select("run_id", "no", "seq", "type", "content").unionByName(made)
