"""Schemas, tables and columns of Spark tables as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def columns(tables: dict[str, DataFrame], schema: str = "public") -> DataFrame:
    """(schema_name, table_name, column_name, data_type, ordinal) of each column; metadata alone, no data is read."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(schema, t, f.name, f.dataType.simpleString(), i) for t, df in sorted(tables.items()) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "schema_name string, table_name string, column_name string, data_type string, ordinal int")
