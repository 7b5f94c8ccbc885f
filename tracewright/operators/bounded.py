"""Folds that keep a bounded number of rows of each key, before anything is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Rows that a task holds before it emits them and starts anew: what it may hold for very many keys.
HELD = 1 << 20


def first_rows(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The n first different rows (keys and order columns) of each key, by the order columns, nulls first.

    Each task folds what it reads to n rows a key, so a key may have any number of rows, equal ones or not; what the tasks
    are left with is shuffled and ranked. Null keys are keys. Other columns aren't carried.
    """
    columns = [*keys, *order]

    def folded(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates().sort_values(columns, na_position="first", kind="stable")
        return frame[frame.groupby(keys, dropna=False, sort=False).cumcount() < n]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = schema = None
        for b in batches:
            schema = b.schema
            frame = folded(b.to_pandas(types_mapper=pd.ArrowDtype))
            held = frame if held is None else folded(pd.concat([held, frame], ignore_index=True))
            if len(held) > HELD:
                yield pa.RecordBatch.from_pandas(held, schema, preserve_index=False)
                held = None
        if held is not None:
            yield pa.RecordBatch.from_pandas(held, schema, preserve_index=False)

    some = df.select(*columns)
    left = some.mapInArrow(run, some.schema).distinct()
    return left.withColumn("_at", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_at") <= n).drop("_at")
