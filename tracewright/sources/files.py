"""Readers of source trees, DDL folders, parsed trees and exports; writers of NDJSON and audit rows."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Extensions by strategy; the first one names a source whose parsed file doesn't say.
EXTENSIONS = {"framework": (".java", ".kt", ".scala"), "dbms": (".sql", ".pls", ".pck", ".pkb", ".pks", ".trg", ".fnc", ".prc")}
_EMPTY = "file string, directory string, content string"


def _read(spark: SparkSession, folder: str, glob: str, recursive: bool) -> DataFrame:
    """(file, directory, content); a folder that is missing or empty gives no rows. Bytes that are no UTF-8 are replaced."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], _EMPTY)
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    full = F.col("path")
    relative = F.regexp_replace(F.regexp_replace(full, "^[a-z]+:/+", "/"), "^" + _quote(str(folder).split("://")[-1].rstrip("/")) + "/?", "")
    directory = F.when(F.instr(relative, "/") > 0, F.regexp_replace(relative, "/[^/]*$", "")).otherwise(F.lit(""))
    # decode() replaces what is malformed only for lenient decoding; is_valid_utf8 guards strict sessions
    text = F.expr("CASE WHEN is_valid_utf8(cast(content AS string)) THEN cast(content AS string) ELSE make_valid_utf8(cast(content AS string)) END")
    return raw.select(F.element_at(F.split(relative, "/"), -1).alias("file"), directory.alias("directory"), F.regexp_replace(text, "^﻿", "").alias("content"))


def _quote(text: str) -> str:
    return "\\Q" + text + "\\E"


def ddl_files(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "*", recursive=False)


def sql_files(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "*.[sS][qQ][lL]", recursive=True)


def parsed_files(spark: SparkSession, folder: str, strategy: str = "dbms") -> DataFrame:
    """(file, directory, content) of parsed trees, *.json below a folder; file is the name of the source."""
    base = F.regexp_replace("file", r"(?i)\.json$", "")
    has = F.lower(base).rlike("(" + "|".join(e.replace(".", r"\.") for e in EXTENSIONS[strategy]) + ")$")
    return _read(spark, folder, "*.json", recursive=True).withColumn("file", F.when(has, base).otherwise(F.concat(base, F.lit(EXTENSIONS[strategy][0]))))


def has_files(spark: SparkSession, folder: str) -> bool:
    return not _read(spark, folder, "*", recursive=True).isEmpty()


EXPORT = T.StructType([
    T.StructField("procedure_name", T.StringType()), T.StructField("procedure_start_line", T.IntegerType()), T.StructField("node_type", T.StringType()),
    T.StructField("procedure_node", T.StructType([T.StructField("properties", T.MapType(T.StringType(), T.StringType()))])),
    *(T.StructField(n, T.StructType([T.StructField("labels", T.ArrayType(T.StringType())), T.StructField("properties", T.MapType(T.StringType(), T.StringType()))])) for n in ("node1", "node2")),
    T.StructField("relationship", T.StructType([T.StructField("type", T.StringType())])),
])


def export_records(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a structured graph export: a JSON array, a byte order mark and control characters allowed."""
    return spark.read.schema(EXPORT).option("multiLine", True).option("allowUnquotedControlChars", True).json(path)


def export_groups(records: DataFrame) -> DataFrame:
    """(procedure_name, procedure_start_line, records): the rows of each procedure gathered, rows without a name dropped."""
    return records.where("procedure_name IS NOT NULL").groupBy("procedure_name", "procedure_start_line").agg(F.collect_list(F.struct("node_type", "node1", "node2", "relationship")).alias("records"))


def request_files(spark: SparkSession, files: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(files, "file string, content string")


def rule(folder: str | Path, name: str) -> str:
    """The text of a prompt rule; read on the driver, it is small and fixed."""
    return (Path(folder) / f"{name}.yaml").read_text()


def parsed_rule(folder: str | Path, name: str) -> dict:
    """The fields of a prompt rule; needs a YAML library, which isn't among this library's own needs."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("prompt rules are YAML; install a YAML library to parse them") from e
    return yaml.safe_load(rule(folder, name)) or {}


def cached_responses(prompts: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(prompts with the response known, prompts without). Keys are hashes of rule and prompt."""
    keyed = prompts.withColumn("prompt_hash", F.sha2(F.concat_ws("\u0001", "rule", "prompt"), 256))
    return keyed.join(cache.select("prompt_hash", "response"), "prompt_hash"), keyed.join(cache, "prompt_hash", "left_anti")


def write_audit(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Audit rows by sort key, else start line (rows with neither last), then time."""
    return spark.read.schema("rule string, sort_key double, start_line int, at timestamp, prompt string, response string").json(path).orderBy(F.coalesce("sort_key", "start_line").asc_nulls_last(), "at")
