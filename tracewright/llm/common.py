"""Small helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import cut, delete, drop, passing, shared_dir

__all__ = ["components", "cut", "delete", "drop", "give_back", "passing", "shared_dir", "slices", "slices_of_bytes", "table"]


def give_back() -> None:
    """Gives freed memory of a Python worker back to the system: workers outlive their tasks, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows, so that what a worker makes of a part stays small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
        del b
        give_back()


def slices_of_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about so many bytes of a string column, of one row at least."""
    for b in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
            yield b.slice(at, end - at)
            at = end


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _neighbour_minimum(edges: DataFrame) -> DataFrame:
    """(u, v, m): each edge with the least of u and all neighbours of u. The minimum is pre-aggregated, so a hub is no hot task."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("hub"), F.least("u", "m").alias("m"))
    return edges.join(least, edges.u == least.hub).drop("hub")


def components(links: DataFrame, u: str, v: str) -> DataFrame:
    """Connected components of the links: (node, component), component being the least node reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the edges no longer change; the number of
    rounds grows with the logarithm of the component size. Nodes without a link to another node are not returned.
    Links with a null end and loops are ignored. Each round's edges are written to the shared folder, in place of the last.
    """
    edges = links.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = cut(edges, "edges"), None
    while True:
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = edges.union(edges.select("v", "u"))
        large = _neighbour_minimum(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.withColumnRenamed("u", "hub"), F.col("u") == F.col("hub")).drop("hub")
        step = small.select("v", "m").union(least.select(F.col("u").alias("v"), "m"))
        edges = cut(step.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges", after=edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
