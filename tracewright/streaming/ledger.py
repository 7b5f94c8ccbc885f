"""A run's ledger: what each file's phases came to, kept in files, and the running of phases that can be stopped.

The ledger is a folder of appended tables, one for each batch of files; a table counts once it is written whole. A run
that starts again reads it and does only what is pending. Jobs of a run carry its tag, so stop(), or the first failure,
ends those that run.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import children, exists
from .events import Control, Stopped

ROW = "directory string, file string, phase int, status string, message string, at timestamp"
PENDING, SKIPPED = "PENDING", "SKIPPED"
#: Batches of files at a time, and into how many a phase is dealt unless said otherwise.
WORKERS, PARTS = 5, 16


def ok(phase: int) -> str:
    return f"PH{phase}_OK"


def failed(phase: int) -> str:
    return f"PH{phase}_FAIL"


class Ledger:
    """Rows are appended and never changed; of a file's rows the one of the latest phase, then the latest time holds, OK before FAIL."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, files: DataFrame, phase: int, status: str, message: str | None = None) -> None:
        """files: directory, file. Written by the executors; it is there whole or not at all."""
        rows = files.select("directory", "file", F.lit(phase).alias("phase"), F.lit(status).alias("status"), F.lit(message).cast("string").alias("message"), F.current_timestamp().alias("at"))
        rows.write.parquet(f"{self.path}/{uuid.uuid4().hex}")

    def rows(self) -> DataFrame:
        whole = [f"{self.path}/{n}" for n in children(self.spark, self.path) if exists(self.spark, f"{self.path}/{n}/_SUCCESS")]
        return self.spark.read.schema(ROW).parquet(*whole) if whole else self.spark.createDataFrame([], ROW)

    def state(self, files: DataFrame) -> DataFrame:
        """(directory, file, status, message) of each of the files; PENDING is one without a row."""
        rank = F.struct("phase", F.when(F.col("status").endswith("_OK"), 1).otherwise(0), "at")
        last = self.rows().groupBy("directory", "file").agg(F.max_by(F.struct("status", "message"), rank).alias("x"))
        at = files.select("directory", "file").distinct().join(last, ["directory", "file"], "left")
        return at.select("directory", "file", F.coalesce("x.status", F.lit(PENDING)).alias("status"), F.col("x.message").alias("message"))

    def pending(self, files: DataFrame, phase: int) -> DataFrame:
        """(directory, file) of the files that the phase is still to be done for: their phase before went well, or there is none before."""
        return self.state(files).where(self._open(phase)).select("directory", "file")

    @staticmethod
    def _open(phase: int) -> Column:
        before = [PENDING] if phase == 1 else [ok(phase - 1)]
        return F.col("status").isin(*before, failed(phase))

    def skip(self, files: DataFrame, phase: int) -> None:
        """Marks what an earlier phase left undone as skipped in this one."""
        gone = self.state(files).where(F.col("status").isin(PENDING, *(failed(k) for k in range(1, phase))))
        self.append(gone, phase, SKIPPED)


def run_phase(ledger: Ledger, control: Control, phase: int, files: DataFrame, work: Callable[[DataFrame], None], parts: int = PARTS, workers: int = WORKERS, strict: bool = True) -> int:
    """Does a phase for the files (directory, file and more) that it is pending for, in parts by a hash of their names.

    work gets the files of a part and writes what comes of them; when it returns, they are done. Returns the number of
    parts that had files. A part that fails is noted with the error. strict: then the others are ended as well and the
    error raised; else they go on. stop() of control ends running jobs and raises Stopped; parts that were done stay done.
    """
    spark, tag = ledger.spark, control.tag
    open_files = ledger.pending(files, phase)
    todo = files.join(open_files, ["directory", "file"], "left_semi").withColumn("_part", F.pmod(F.xxhash64("directory", "file"), F.lit(parts)))
    numbers = [r._part for r in todo.select("_part").distinct().orderBy("_part").collect()]  # as many as parts

    def one(number: int) -> None:
        control.check()
        spark.sparkContext.addJobTag(tag)
        mine = todo.where(F.col("_part") == number).drop("_part")
        try:
            work(mine)
            ledger.append(mine, phase, ok(phase))
        except Exception as e:
            if control.stopped:
                raise Stopped from e
            spark.sparkContext.removeJobTag(tag)
            ledger.append(mine, phase, failed(phase), f"{type(e).__name__}: {e}"[:500])
            raise
        finally:
            spark.sparkContext.removeJobTag(tag)

    errors = []
    with ThreadPoolExecutor(workers) as pool:
        running = {pool.submit(one, n) for n in numbers}
        while running:
            done, running = wait(running, return_when=FIRST_EXCEPTION)
            errors += [e for e in (f.exception() for f in done) if e]
            if errors and (strict or control.stopped):
                for f in running:
                    f.cancel()
                control.end_jobs(spark)
                wait(running)
                break
    if control.stopped:
        raise Stopped
    if errors and strict:
        raise next((e for e in errors if not isinstance(e, Stopped)), errors[0])
    return len(numbers)
