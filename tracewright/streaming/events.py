"""Progress events as NDJSON, batch and streaming, and control of a running analysis."""

from __future__ import annotations

import threading
import uuid
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.streaming import StreamingQuery

_TEXT = "content errorType traceId graph current_file action nodeType nodeName relType source target updateType tableName schema field name status summary"
#: Every kind of event in one wide row; fields that a kind lacks are null and are not written.
EVENT = T.StructType([T.StructField("seq", T.LongType()), T.StructField("type", T.StringType()), *(T.StructField(n, T.StringType()) for n in _TEXT.split()), T.StructField("line_number", T.LongType()), T.StructField("analysis_progress", T.IntegerType()), T.StructField("phase", T.DoubleType()), T.StructField("progress", T.IntegerType())])
TYPES = ("message", "data", "error", "node_event", "relationship_event", "canvas_update", "phase_event", "complete")


def ndjson(events: DataFrame) -> DataFrame:
    """(seq, value) of events: one JSON object each, null fields left out."""
    rest = [c for c in events.columns if c != "seq"]
    return events.select("seq", F.to_json(F.struct(*rest), {"ignoreNullFields": "true"}).alias("value"))


def closed(events: DataFrame) -> DataFrame:
    """events of each run, up to its first error, with one 'complete' at the end. Runs are told apart by run_id."""
    w = W.partitionBy("run_id").orderBy("seq")
    cut = events.where("type <> 'complete'").withColumn("_e", F.sum(F.when(F.col("type") == "error", 1).otherwise(0)).over(w)).where("_e = 0 OR (_e = 1 AND type = 'error')").drop("_e")
    ends = cut.groupBy("run_id").agg((F.max("seq") + 1).alias("seq")).withColumn("type", F.lit("complete"))
    return cut.unionByName(ends, allowMissingColumns=True)


def progress(items: DataFrame, group: list[str], order: list[str], low: int = 0, high: int = 100, cap: int = 99) -> DataFrame:
    """items with progress: from low to high over the items of a group, never above cap before the end is announced."""
    at, n = F.row_number().over(W.partitionBy(*group).orderBy(*order)), F.count("*").over(W.partitionBy(*group))
    return items.withColumn("progress", F.least(F.lit(cap), F.floor(F.lit(low) + (high - low) * at / n)).cast("int"))


def stream(spark: SparkSession, source: str, target: str, checkpoint: str, kinds: tuple[str, ...] = TYPES, once: bool = True) -> StreamingQuery:
    """Follows a folder of event files (JSON rows of EVENT) and appends their NDJSON as text to another one."""
    events = spark.readStream.schema(EVENT).json(source).where(F.col("type").isin(*kinds))
    writer = ndjson(events).select("value").writeStream.format("text").option("path", target).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def stream_counts(spark: SparkSession, source: str, schema: T.StructType, time: str, key: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """A streaming frame with the events of each window and key; later ones than `late` are dropped."""
    rows = spark.readStream.schema(schema).parquet(source).withWatermark(time, late)
    return rows.groupBy(F.window(time, window), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


class Phase(Enum):
    IDLE = "idle"
    DDL = "ddl"
    AST = "ast"
    ANALYSIS = "analysis"
    METADATA = "metadata"
    VECTORS = "vectors"
    LINEAGE = "lineage"
    DONE = "done"


class Stopped(Exception):
    """Raised at the next check after stop()."""


class Control:
    """Pause, resume and stop of a run on the driver; check() is called between phases and batches.

    Jobs that carry the tag (SparkContext.addJobTag) belong to the run: stop() ends them where a session is given.
    """

    def __init__(self) -> None:
        self._go, self._stop, self.phase, self._progress = threading.Event(), False, Phase.IDLE, 0
        self.tag = f"run-{uuid.uuid4().hex}"
        self._go.set()

    @property
    def stopped(self) -> bool:
        return self._stop

    def end_jobs(self, spark: SparkSession) -> None:
        spark.sparkContext.cancelJobsWithTag(self.tag)

    def pause(self) -> None:
        self._go.clear()

    def resume(self) -> None:
        self._go.set()

    def stop(self, query: StreamingQuery | None = None, spark: SparkSession | None = None) -> None:
        self._stop = True
        self._go.set()
        if spark is not None:
            self.end_jobs(spark)
        if query is not None:
            query.stop()

    def check(self, timeout: float | None = None) -> None:
        self._go.wait(timeout)
        if self._stop:
            raise Stopped

    def enter(self, phase: Phase) -> None:
        self.check()
        self.phase, self._progress = phase, 0

    @property
    def progress(self) -> int:
        return self._progress

    @progress.setter
    def progress(self, value: float) -> None:
        self._progress = int(max(0, min(100, value)))

    def status(self) -> dict[str, object]:
        return {"phase": self.phase.value, "paused": not self._go.is_set(), "stopped": self._stop, "progress": self._progress}


def runnable(files: DataFrame) -> DataFrame:
    """Files whose first phase succeeded: the second one skips the rest."""
    return files.where("phase1 = 'OK'")


def fail_fast(batches: DataFrame) -> None:
    """Raises if any batch failed."""
    bad = batches.where("NOT ok").limit(1).collect()
    if bad:
        raise RuntimeError(f"batch failed: {bad[0].asDict()}")
