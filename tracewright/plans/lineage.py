"""Data lineage of SQL procedures: what each writes and reads, and the flows between tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed

_NAME = r"(\w+(?:\.\w+)?)"
PROCEDURE = r"(?is)CREATE\s+(?:OR\s+REPLACE\s+)?(?:PROCEDURE|FUNCTION)\s+(\w+)\s*(?:\([^)]*\))?\s*(?:AS|IS)?\s*(.*?)(?=CREATE\s+(?:OR\s+REPLACE\s+)?(?:PROCEDURE|FUNCTION)|\z)"
TARGETS = {"INSERT": rf"(?i)INSERT\s+INTO\s+{_NAME}", "MERGE": rf"(?i)MERGE\s+INTO\s+{_NAME}", "UPDATE": rf"(?i)UPDATE\s+{_NAME}\s+SET", "DELETE": rf"(?i)DELETE\s+FROM\s+{_NAME}"}
SOURCES = (rf"(?i)FROM\s+{_NAME}", rf"(?i)JOIN\s+{_NAME}", rf"(?is)USING\s*\(\s*SELECT.*?FROM\s+{_NAME}")


def procedures(files: DataFrame) -> DataFrame:
    """(file, etl_name, body): a row per procedure or function; a file without one is a unit of its own, named as the file."""
    zipped = F.arrays_zip(F.regexp_extract_all("content", F.lit(PROCEDURE), F.lit(1)).alias("n"), F.regexp_extract_all("content", F.lit(PROCEDURE), F.lit(2)).alias("b"))
    whole = F.array(F.struct(F.coalesce(F.nullif(F.col("file"), F.lit("")), F.lit("UNKNOWN")).alias("n"), F.col("content").alias("b")))
    found = files.where(F.col("content").isNotNull()).select("file", "content", zipped.alias("z"))
    each = found.select("file", F.posexplode(F.when(F.size("z") > 0, F.col("z")).otherwise(whole)).alias("pos", "p"))
    return each.select("file", "pos", F.col("p.n").alias("etl_name"), F.col("p.b").alias("body"))


def _tables(pattern: str) -> Column:
    """Upper-cased names that a pattern finds in the body, without system names."""
    return F.filter(F.transform(F.regexp_extract_all("body", F.lit(pattern), F.lit(1)), F.upper), lambda t: ~F.lower(t).isin(*fixed.SYSTEM_NAMES))


def analyse(units: DataFrame) -> DataFrame:
    """(file, etl_name, source_tables, target_tables, operation_type, is_etl) of units (file, etl_name, body) that touch a table.

    Tables written to don't count as sources. MERGE names the operation before INSERT, UPDATE and DELETE; with sources
    and targets, or with several targets, it is ETL.
    """
    found = units.select("file", "etl_name", *(_tables(p).alias(k) for k, p in TARGETS.items()), *(_tables(p).alias(f"s{i}") for i, p in enumerate(SOURCES)))
    targets = F.array_sort(F.array_distinct(F.concat(*TARGETS)))
    sources = F.array_sort(F.array_except(F.concat(*(f"s{i}" for i in range(len(SOURCES)))), "target_tables"))
    out = found.withColumn("target_tables", targets).withColumn("source_tables", sources)
    etl = ((F.size("source_tables") > 0) & (F.size("target_tables") > 0)) | (F.size("target_tables") > 1)
    single = F.lit("ETL")
    for kind in ("DELETE", "UPDATE", "INSERT", "MERGE"):
        single = F.when(F.size(kind) > 0, kind).otherwise(single)
    out = out.withColumn("is_etl", etl).withColumn("operation_type", F.when(etl, "ETL").otherwise(single))
    return out.where((F.size("source_tables") > 0) | (F.size("target_tables") > 0)).select("file", "etl_name", "source_tables", "target_tables", "operation_type", "is_etl")


def edges(lineage: DataFrame) -> DataFrame:
    """(src, dst, type, via_etl, operation, file) of ETL units: ETL_READS, ETL_WRITES and table to table DATA_FLOWS_TO."""
    etl = lineage.where("is_etl")
    rest = [F.col("etl_name").alias("via_etl"), F.col("operation_type").alias("operation"), "file"]
    reads = etl.select(F.col("etl_name").alias("src"), F.explode("source_tables").alias("dst"), F.lit("ETL_READS").alias("type"), *rest)
    writes = etl.select(F.col("etl_name").alias("src"), F.explode("target_tables").alias("dst"), F.lit("ETL_WRITES").alias("type"), *rest)
    flows = etl.select(F.explode("source_tables").alias("src"), "target_tables", *rest).select("src", F.explode("target_tables").alias("dst"), F.lit("DATA_FLOWS_TO").alias("type"), "via_etl", "operation", "file")
    return reads.unionByName(writes).unionByName(flows)


def matched(flow: DataFrame, tables: DataFrame) -> DataFrame:
    """The flows whose tables exist: names compare without schema and case, so one name may match several tables."""
    bare = lambda c: F.lower(F.element_at(F.split(c, r"\."), -1))
    known = tables.select(F.lower("table_name").alias("k"), "schema_name", "table_name")
    a = known.select(F.col("k").alias("ka"), F.concat_ws(".", "schema_name", "table_name").alias("src_table"))
    b = known.select(F.col("k").alias("kb"), F.concat_ws(".", "schema_name", "table_name").alias("dst_table"))
    return flow.where("type = 'DATA_FLOWS_TO'").join(a, bare(F.col("src")) == F.col("ka")).join(b, bare(F.col("dst")) == F.col("kb")).drop("ka", "kb")


def graph(lineage: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the lineage view: tables are SOURCE, TARGET or both, procedures are ETL."""
    flow = edges(lineage)
    roles = flow.where("type <> 'DATA_FLOWS_TO'").select(F.col("dst").alias("name"), F.when(F.col("type") == "ETL_READS", "SOURCE").otherwise("TARGET").alias("role"))
    nodes = roles.groupBy("name").agg(F.array_join(F.sort_array(F.collect_set("role")), "+").alias("node_type"))
    units = flow.where("type <> 'DATA_FLOWS_TO'").select(F.col("src").alias("name"), F.lit("ETL").alias("node_type")).distinct()
    return nodes.unionByName(units), flow


def statistics(lineage: DataFrame) -> DataFrame:
    """(file, lineages, etl_count, sources, targets, flows) per file."""
    each = lineage.select("file", "etl_name", "is_etl", F.explode_outer("source_tables").alias("s"), "target_tables")
    per = each.groupBy("file").agg(F.countDistinct("s").alias("sources"))
    out = lineage.select("file", "etl_name", "is_etl", F.explode_outer("target_tables").alias("t")).groupBy("file").agg(F.countDistinct("t").alias("targets"))
    n = lineage.groupBy("file").agg(F.count("*").alias("lineages"), F.count_if("is_etl").alias("etl_count"), F.sum(F.when(F.col("is_etl"), F.size("source_tables") * F.size("target_tables")).otherwise(0)).alias("flows"))
    return n.join(per, "file").join(out, "file").select("file", "lineages", "etl_count", "sources", "targets", "flows")
