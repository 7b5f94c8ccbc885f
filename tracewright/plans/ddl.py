"""DDL texts to typed rows of tables, columns, keys and comments, by regular expressions in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import fqn, name_case

CREATE = r'(?is)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?([\w."]+)\s*\((.*?)\)\s*;'
#: A quoted text with doubled quotes; possessive, so that long comments need no stack.
_TEXT = r"'([^']*+(?:''[^']*+)*+)'"
TABLE_COMMENT = rf'(?is)COMMENT\s+ON\s+TABLE\s+([\w."]+)\s+IS\s+{_TEXT}\s*;'
COLUMN_COMMENT = rf'(?is)COMMENT\s+ON\s+COLUMN\s+([\w."]+)\.([\w"]+)\s+IS\s+{_TEXT}\s*;'
PRIMARY_KEY = r'(?i)ALTER\s+TABLE\s+([\w."]+)\s+ADD\s+(?:CONSTRAINT\s+[\w"]+\s+)?PRIMARY\s+KEY\s*\(([^)]+)\)\s*;'
FOREIGN_KEY = r'(?i)ALTER\s+TABLE\s+([\w."]+)\s+ADD\s+(?:CONSTRAINT\s+[\w"]+\s+)?FOREIGN\s+KEY\s*\(([^)]+)\)\s+REFERENCES\s+([\w."]+)\s*\(([^)]+)\)'
COLUMN = r'^"?(\w+)"?\s+([A-Za-z_]+(?:\s*\([^)]*\))?)(.*)$'
#: First words of lines of a table's definition that are no columns; strict keeps to the first two.
NO_COLUMNS, NO_COLUMNS_STRICT = "CONSTRAINT|PRIMARY|FOREIGN|UNIQUE|CHECK|INDEX|KEY", "CONSTRAINT|PRIMARY"


def _all(df: DataFrame, pattern: str, *names: str) -> DataFrame:
    """A row per match: file, pos (order in the file) and the groups under the given names."""
    groups = [F.regexp_extract_all("content", F.lit(pattern), F.lit(i)).alias(n) for i, n in enumerate(names, 1)]
    zipped = df.select("file", F.arrays_zip(*groups).alias("m"))
    return zipped.select("file", F.posexplode("m").alias("pos", "x")).select("file", "pos", *(F.col("x")[n].alias(n) for n in names))


def _plain(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), "^\"(.*)\"$|^'(.*)'$", "$1$2")


def _named(c: Column) -> tuple[Column, Column]:
    """(schema, name) of a dotted name; only the first two parts count."""
    parts = F.split(c, r"\.")
    two = F.size(parts) >= 2
    return F.when(two, _plain(F.get(parts, F.lit(0)))).otherwise(F.lit("")), _plain(F.when(two, F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0))))


def _keyed(df: DataFrame, name: str, case: str, default: str) -> DataFrame:
    schema, table = _named(F.col(name))
    return df.withColumns({"schema_name": name_case(F.coalesce(F.nullif(schema, F.lit("")), F.lit(default)), case), "table_name": name_case(table, case)}).drop(name)


def created(texts: DataFrame, case: str = "original", default: str = "public") -> DataFrame:
    """(schema_name, table_name, file, pos, body): one row per table. Of repeated CREATEs the last body holds, at the first place."""
    found = _keyed(_all(texts, CREATE, "name", "body"), "name", case, default)
    return found.groupBy("schema_name", "table_name").agg(F.min(F.struct("file", "pos")).alias("at"), F.max_by("body", F.struct("file", "pos")).alias("body")).select("schema_name", "table_name", "at.file", "at.pos", "body")


def tables(texts: DataFrame, case: str = "original", default: str = "public") -> DataFrame:
    """(schema_name, table_name, description, table_type, is_stub): created tables and, as stubs, the targets of foreign keys."""
    made = created(texts, case, default).select("schema_name", "table_name", F.lit(False).alias("is_stub"))
    said = _keyed(_all(texts, TABLE_COMMENT, "name", "text"), "name", case, default)
    said = said.groupBy(F.lower("schema_name").alias("s"), F.lower("table_name").alias("t")).agg(F.max_by("text", F.struct("file", "pos")).alias("text"))
    targets = foreign_keys(texts, case, default).select(F.col("to_schema").alias("schema_name"), F.col("to_table").alias("table_name")).distinct()
    stubs = targets.join(made, ["schema_name", "table_name"], "left_anti").withColumn("is_stub", F.lit(True))
    every = made.unionByName(stubs)
    joined = every.join(said, (F.lower("schema_name") == F.col("s")) & (F.lower("table_name") == F.col("t")), "left")
    return joined.select("schema_name", "table_name", F.coalesce(F.replace("text", F.lit("''"), F.lit("'")), F.lit("")).alias("description"), F.lit("BASE TABLE").alias("table_type"), "is_stub")


def columns(texts: DataFrame, case: str = "original", default: str = "public", strict: bool = False) -> DataFrame:
    """(schema_name, table_name, column_name, ordinal, dtype, nullable, description, pk_constraint, fqn) of created tables.

    One column a line. strict keeps FOREIGN, UNIQUE and the like as columns, as a plain reading of the lines does.
    """
    skipped = NO_COLUMNS_STRICT if strict else NO_COLUMNS
    line = F.trim(F.regexp_replace(F.btrim(F.col("l"), F.lit(" \t\r\n")), ",+$", ""))
    split = created(texts, case, default).select("schema_name", "table_name", F.posexplode(F.split("body", "\n")).alias("ordinal", "l")).withColumn("l", line)
    split = split.where((F.col("l") != "") & ~F.col("l").rlike(f"(?i)^({skipped})" + ("" if strict else r"\b")) & F.col("l").rlike("(?is)" + COLUMN))
    part = lambda i: F.regexp_extract("l", "(?is)" + COLUMN, i)
    found = split.select("schema_name", "table_name", name_case(part(1), case).alias("column_name"), "ordinal", F.trim(part(2)).alias("dtype"), (~F.upper(part(3)).contains("NOT NULL")).alias("nullable"))
    said = _keyed(_all(texts, COLUMN_COMMENT, "name", "column", "text"), "name", case, default)
    said = said.groupBy(F.lower("schema_name").alias("s"), F.lower("table_name").alias("t"), F.lower(_plain(F.col("column"))).alias("c")).agg(F.max_by("text", F.struct("file", "pos")).alias("text"))
    keys = primary_keys(texts, case, default).select(F.lower("schema_name").alias("ks"), F.lower("table_name").alias("kt"), F.lower("column_name").alias("kc"))
    out = found.join(said, (F.lower("schema_name") == F.col("s")) & (F.lower("table_name") == F.col("t")) & (F.lower("column_name") == F.col("c")), "left")
    out = out.join(keys, (F.lower("schema_name") == F.col("ks")) & (F.lower("table_name") == F.col("kt")) & (F.lower("column_name") == F.col("kc")), "left")
    constraint = F.when(F.col("kc").isNotNull(), F.concat("table_name", F.lit("_pkey")))
    return out.select("schema_name", "table_name", "column_name", "ordinal", "dtype", "nullable", F.coalesce(F.replace("text", F.lit("''"), F.lit("'")), F.lit("")).alias("description"), constraint.alias("pk_constraint"), fqn(F.col("schema_name"), F.col("table_name"), F.col("column_name")).alias("fqn"))


def primary_keys(texts: DataFrame, case: str = "original", default: str = "public") -> DataFrame:
    """(schema_name, table_name, column_name, ordinal); the last statement of a table holds."""
    found = _keyed(_all(texts, PRIMARY_KEY, "name", "cols"), "name", case, default)
    last = found.groupBy("schema_name", "table_name").agg(F.max_by("cols", F.struct("file", "pos")).alias("cols"))
    return last.select("schema_name", "table_name", F.posexplode(F.split("cols", ",")).alias("ordinal", "c")).select("schema_name", "table_name", name_case(_plain(F.col("c")), case).alias("column_name"), "ordinal")


def foreign_keys(texts: DataFrame, case: str = "original", default: str = "public") -> DataFrame:
    """(schema_name, table_name, column_name, to_schema, to_table, to_column): composite keys give a row per column pair."""
    found = _keyed(_all(texts, FOREIGN_KEY, "name", "cols", "target", "refs"), "name", case, default)
    schema, table = _named(F.col("target"))
    pairs = F.arrays_zip(F.split("cols", ",").alias("a"), F.split("refs", ",").alias("b"))
    each = found.select("schema_name", "table_name", name_case(F.coalesce(F.nullif(schema, F.lit("")), F.lit(default)), case).alias("to_schema"), name_case(table, case).alias("to_table"), F.explode(pairs).alias("p"))
    each = each.where(F.col("p.a").isNotNull() & F.col("p.b").isNotNull())
    return each.select("schema_name", "table_name", name_case(_plain(F.col("p.a")), case).alias("column_name"), "to_schema", "to_table", name_case(_plain(F.col("p.b")), case).alias("to_column")).distinct()


def schemas(texts: DataFrame, case: str = "original", default: str = "public") -> DataFrame:
    """(schema_name, first_file): the schemas in the order in which they appear."""
    return created(texts, case, default).groupBy("schema_name").agg(F.min(F.struct("file", "pos")).alias("at")).orderBy("at").select("schema_name", F.col("at.file").alias("first_file"))


def statistics(texts: DataFrame) -> DataFrame:
    """One row: numbers of files, tables, columns, foreign keys."""
    counts = [df.agg(F.count("*").alias(n)) for n, df in (("files", texts.select("file").distinct()), ("tables", created(texts)), ("columns", columns(texts)), ("foreign_keys", foreign_keys(texts)))]
    out = counts[0].withColumn("one", F.lit(1))
    for c in counts[1:]:
        out = out.join(c.withColumn("one", F.lit(1)), "one")
    return out.drop("one")


def ranked_duplicates(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
