"""Foreign keys inferred from names, types and values."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.similarity import name_similarity, types_compatible
from ..operators import similar
from ..sources.tables import cut

THRESHOLD, SAMPLE, MATCH = 0.8, 25, 0.8
_KEY = ("schema_name", "table_name", "column_name")


#: Least insert-delete similarity of names that have the threshold: the other half of the measure is at most 0.95 unless
#: the names are all but equal, and less where their lengths differ much.
_BOUND = lambda threshold: max(0.05, min(2 * threshold - 0.95, threshold))


def candidates(columns: DataFrame, existing: DataFrame | None = None, threshold: float = THRESHOLD, similarity: Column | None = None, both_ways: bool = False) -> DataFrame:
    """Column pairs of different tables with compatible types and similar names, the best first.

    existing: known keys with the same from_/to_ columns, which are left out. similarity: a measure over a and b, two names; it
    may not be above the insert-delete similarity. Different names are compared, each pair once, then columns are
    looked up by name. Names that are empty have no pairs.
    """
    names = columns.select(F.col("column_name").alias("a")).distinct()
    bound, score = (_BOUND(threshold), name_similarity("a", "b")) if similarity is None else (threshold, similarity)
    near = cut(similar.similar(names, names.withColumnRenamed("a", "b"), threshold, score, bound), "names")
    a = columns.select(*(F.col(c).alias(f"from_{c}") for c in (*_KEY, "data_type")))
    b = columns.select(*(F.col(c).alias(f"to_{c}") for c in (*_KEY, "data_type")))
    earlier = F.struct("from_schema_name", "from_table_name") < F.struct("to_schema_name", "to_table_name")
    other = (F.col("from_schema_name") != F.col("to_schema_name")) | (F.col("from_table_name") != F.col("to_table_name"))
    found = a.join(near, F.col("from_column_name") == F.col("a")).join(b, (F.col("to_column_name") == F.col("b")) & (other if both_ways else earlier))
    found = found.where(types_compatible(F.col("from_data_type"), F.col("to_data_type"))).drop("a", "b")
    if existing is not None:
        found = found.join(existing, [f"{side}_{c}" for side in ("from", "to") for c in _KEY], "left_anti")
    rest = [f"{side}_{c}" for side in ("from", "to") for c in (*_KEY, "data_type")]
    return found.select(*rest, "similarity").orderBy(F.desc("similarity"), *(f"{side}_{c}" for side in ("from", "to") for c in _KEY))


def _is_number(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def _comparable(df: DataFrame, column: str) -> Column:
    """A column as a double or a text, so that numbers of any type compare as numbers and never equal a text."""
    return F.col(column).cast("double" if _is_number(df, column) else "string")


def least_values(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """(column_name, family, value): the n least different non-null values of each column, in one scan.

    Each task keeps n values a column, whatever it reads; only those are shuffled and ranked.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, pa.Array] = {}
        for b in batches:
            for c in columns:
                some = b.column(c).drop_null().unique()
                some = pa.concat_arrays([held[c], some]).unique() if c in held else some
                held[c] = some.take(pc.sort_indices(some)[:n])
        for c, v in held.items():
            text = pa.types.is_string(v.type) or pa.types.is_large_string(v.type)
            none = pa.nulls(len(v))
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(v), pa.string()), (none if text else v).cast(pa.float64()), (v if text else none).cast(pa.string())], names=["column_name", "number", "text"])

    found = df.select(*(_comparable(df, c).alias(c) for c in columns)).mapInArrow(run, "column_name string, number double, text string").distinct()
    first = found.withColumn("at", F.row_number().over(W.partitionBy("column_name").orderBy("number", "text"))).where(F.col("at") <= n)
    return first.select("column_name", F.when(F.col("number").isNull(), "text").otherwise("number").alias("family"), F.coalesce(F.col("number").cast("string"), "text").alias("value"))


def _by_table(wanted: list[tuple[str, str]]) -> list[tuple[str, list[str]]]:
    names: dict[str, list[str]] = {}
    for t, c in sorted(set(wanted)):
        names.setdefault(t, []).append(c)
    return list(names.items())


#: Asked values of a column up to which its rows are filtered by a set of them; beyond, a join alone does it.
IN_SET = 10_000


def values(tables: dict[str, DataFrame], asked: dict[tuple[str, str], tuple[list[float], list[str]] | None]) -> DataFrame:
    """(table_name, column_name, family, value): the different non-null values of each column that are among the asked ones.

    asked: per (table, column) the numbers and texts in question, None for any. One scan a table; a row gives only the
    values that are asked for, so hardly any row leaves the scan.
    """

    def value(df: DataFrame, t: str, c: str) -> Column:
        number, want = _is_number(df, c), asked[t, c]
        v = _comparable(df, c)
        some = F.lit(True) if want is None else v.isin(*want[0 if number else 1]) if want[0 if number else 1] else F.lit(False)
        return F.when(v.isNotNull() & some, F.struct(F.lit(c).alias("column_name"), F.lit("number" if number else "text").alias("family"), v.cast("string").alias("value")))

    parts = []
    for t, cs in _by_table(list(asked)):
        each = F.filter(F.array(*(value(tables[t], t, c) for c in cs)), lambda x: x.isNotNull())
        parts.append(tables[t].select(F.lit(t).alias("table_name"), F.explode(each).alias("v")).select("table_name", "v.*"))
    return reduce(DataFrame.unionByName, parts).distinct()


def _asked(asked: DataFrame, targets: list[tuple[str, str]]) -> dict[tuple[str, str], tuple[list[float], list[str]] | None]:
    """What values() filters each target column by: the asked values if they are few. asked has a sample's values a pair of columns."""
    few = asked.groupBy("at", "ac").agg(F.when(F.count("*") <= IN_SET, F.lit(True)).alias("few")).where("few")
    held: dict[tuple[str, str], tuple[list[float], list[str]] | None] = dict.fromkeys(targets)
    rows = asked.join(few, ["at", "ac"]).toLocalIterator()  # at most columns in question times the sample
    for k in few.collect():
        held[k.at, k.ac] = ([], [])
    for r in rows:
        held[r.at, r.ac][0 if r.af == "number" else 1].append(float(r.av) if r.af == "number" else r.av)
    return held


def verify(found: DataFrame, tables: dict[str, DataFrame], sample: int = SAMPLE, least: float = MATCH) -> DataFrame:
    """found with total_samples, matched_count and match_ratio, where enough of a sample of source values occur in the target.

    The sample are the least different values, so that it is the same each time. One plan serves all candidates; the
    list of columns in question is metadata and is read on the driver.
    """
    found = cut(found, "candidates")  # as many rows as column pairs
    names = [tuple(r) for r in found.select("from_table_name", "from_column_name").distinct().collect()]
    targets = [tuple(r) for r in found.select("to_table_name", "to_column_name").distinct().collect()]
    scalar = lambda t, c: not isinstance(tables[t].schema[c].dataType, (T.ArrayType, T.MapType, T.StructType))
    names, targets = [x for x in names if scalar(*x)], [x for x in targets if scalar(*x)]
    if not names or not targets:
        return found.withColumns({"total_samples": F.lit(0).cast("long"), "matched_count": F.lit(0).cast("long"), "match_ratio": F.lit(0.0)}).limit(0)
    taken = reduce(DataFrame.unionByName, (least_values(tables[t], cs, sample).withColumn("table_name", F.lit(t)) for t, cs in _by_table(names)))
    probe = cut(found.join(taken, (F.col("from_table_name") == F.col("table_name")) & (F.col("from_column_name") == F.col("column_name"))).drop("table_name", "column_name"), "probe")
    # As many rows as pairs of columns times the sample; written, so that the planner knows its size. The target side
    # keeps only rows that are asked for, before it is shuffled.
    asked = cut(probe.select(F.col("to_table_name").alias("at"), F.col("to_column_name").alias("ac"), F.col("family").alias("af"), F.col("value").alias("av")).distinct(), "asked")
    target = values(tables, {k: v for k, v in _asked(asked, targets).items() if k in set(targets)})
    target = target.join(asked, (F.col("table_name") == F.col("at")) & (F.col("column_name") == F.col("ac")) & (F.col("family") == F.col("af")) & (F.col("value") == F.col("av")), "left_semi").distinct()
    target = target.select(F.col("table_name").alias("tt"), F.col("column_name").alias("tc"), F.col("family").alias("tf"), F.col("value").alias("tv"))
    hit = probe.join(target, (F.col("to_table_name") == F.col("tt")) & (F.col("to_column_name") == F.col("tc")) & (F.col("family") == F.col("tf")) & (F.col("value") == F.col("tv")), "left")
    out = hit.groupBy(*found.columns).agg(F.count("*").alias("total_samples"), F.count("tv").alias("matched_count"))
    out = out.withColumn("match_ratio", F.col("matched_count") / F.col("total_samples"))
    return out.where(F.col("match_ratio") >= least)


def as_edges(verified: DataFrame) -> DataFrame:
    """Foreign keys as table-to-table edges with their properties."""
    return verified.select(
        F.concat_ws(".", "from_schema_name", "from_table_name").alias("src"), F.concat_ws(".", "to_schema_name", "to_table_name").alias("dst"), F.lit("FK_TO_TABLE").alias("type"),
        F.col("from_column_name").alias("source_column"), F.col("to_column_name").alias("target_column"), F.lit("many_to_one").alias("cardinality"), F.lit("sample_data_inference").alias("source"), "similarity", "match_ratio",
    )
