"""The metadata phase: blank descriptions filled from samples of the tables, inferred keys saved."""

from __future__ import annotations

from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph
from ..sources.tables import cut
from . import fk, providers

#: Rows of a table that are looked at.
SAMPLE = 25


def sample(df: DataFrame, rows: int = SAMPLE, order: str | None = None) -> DataFrame:
    """Some rows of a table; with a column to order by, its first ones, so that it is the same each time."""
    return df.orderBy(order).limit(rows) if order else df.limit(rows)


def fill(columns: DataFrame, tables: dict[str, DataFrame], order: dict[str, str] | None = None) -> tuple[DataFrame, list[str]]:
    """columns (table_name, column_name, description, description_source, ...) with blank descriptions filled by profiles, and the tables that failed.

    Each table's profile, a row for each of its columns, is made and written by itself; one that can't be read then is named
    and left as it is, and the others are filled.
    """
    found, failed = [], []
    for name, df in sorted(tables.items()):
        try:
            profile = providers.profile(df, SAMPLE, (order or {}).get(name))
            found.append(cut(profile.select(F.lit(name).alias("table_name"), "column_name", F.col("profile").alias("text")), "profile"))
        except (PySparkException, Py4JJavaError):
            failed.append(name)
    if not found:
        return columns, failed
    at = columns.join(reduce(DataFrame.unionByName, found), ["table_name", "column_name"], "left")
    blank = (F.trim(F.coalesce("description", F.lit(""))) == "") & F.col("text").isNotNull()
    changed = {"description": F.when(blank, F.col("text")).otherwise(F.col("description")), "description_source": F.when(blank, "sample").otherwise(F.col("description_source"))}
    return at.select(*(changed.get(c, F.col(c)).alias(c) for c in columns.columns)), failed


def save_keys(known: DataFrame, verified: DataFrame) -> DataFrame:
    """known (src, dst, type, source_column, target_column, cardinality, source, similarity, match_ratio) and the inferred keys.

    A key that is known keeps its source if that is the definition; else the inferred one's values win.
    """
    keys = ["src", "dst", "type", "source_column", "target_column"]
    return graph.upsert(known, fk.as_edges(verified), keys, {"source": graph.source_priority()})
