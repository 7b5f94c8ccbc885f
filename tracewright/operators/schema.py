"""The schema browser: tables, columns, keys, references, descriptions, star schemas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import graph
from .bounded import first_rows

#: Different descriptions and examples of a column that its uses are summed up with.
DESCRIPTIONS, EXAMPLES = 100, 5


def matching(search: str | None, *columns: str) -> Column:
    """Whether one of the columns contains the text, case ignored; no text fits all."""
    if not search:
        return F.lit(True)
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.contains(F.lower(c), F.lit(search.lower())), F.lit(False))
    return out


def list_tables(tables: DataFrame, columns: DataFrame, search: str | None = None, schema: str | None = None, limit: int = 100) -> DataFrame:
    """(schema_name, table_name, description, column_count) by name; tables without columns count 0."""
    at = tables.where(matching(search, "table_name", "description"))
    if schema:
        at = at.where(F.col("schema_name") == schema)
    counts = columns.groupBy("schema_name", "table_name").agg(F.count("*").alias("n"))
    return at.join(counts, ["schema_name", "table_name"], "left").select("schema_name", "table_name", "description", F.coalesce("n", F.lit(0)).alias("column_count")).orderBy("table_name", "schema_name").limit(limit)


def is_named(name: str, table: str = "table_name", schema: str = "schema_name") -> Column:
    """Whether a table is called so: by its name, or its schema.table ends with the text as it is typed (case ignored there)."""
    return F.coalesce((F.col(table) == name) | F.lower(F.concat_ws(".", schema, table)).endswith(name.lower()), F.lit(False))


def list_columns(columns: DataFrame, table: str, schema: str | None = None) -> DataFrame:
    """The columns of a table; without a schema, of all tables that the text names (is_named)."""
    at = columns.where((F.col("table_name") == table) & (F.col("schema_name") == schema) if schema else is_named(table))
    return at.orderBy("ordinal", "column_name")


def list_relationships(fks: DataFrame, table: str | None = None) -> DataFrame:
    at = fks if not table else fks.where((F.col("from_table") == table) | (F.col("to_table") == table))
    return at.orderBy("from_table", "to_table", "from_column")


def add_relationship(fks: DataFrame, from_table: str, from_column: str, to_table: str, to_column: str) -> DataFrame:
    """fks with a key set by a user; keys are told apart by their columns, too."""
    from .graph import upsert

    row = fks.sparkSession.createDataFrame([(from_table, from_column, to_table, to_column, "user")], "from_table string, from_column string, to_table string, to_column string, source string")
    return upsert(fks.select("from_table", "from_column", "to_table", "to_column", "source"), row, ["from_table", "from_column", "to_table", "to_column"])


def references(uses: DataFrame, nodes: DataFrame, edges: DataFrame, table: str) -> DataFrame:
    """(unit, statement, type) of statements that use a table, with the procedure above them.

    uses: src, table_name, type; nodes: node_id, kind, name; edges: src, dst of the tree, of which only what stands above the
    statements is walked.
    """
    units = nodes.where(F.col("kind").isin("PROCEDURE", "FUNCTION", "TRIGGER")).select(F.col("node_id").alias("src"), F.col("name").alias("unit"))
    at = uses.where((F.col("table_name") == table) & F.col("type").isin("FROM", "WRITES")).select(F.col("src").alias("node"), "type")
    above = graph.reached(edges, at, "node").withColumnRenamed("node", "src").join(units, "src").select(F.col("start").alias("node"), "unit")
    return at.join(above, "node", "left").select("unit", F.col("node").alias("statement"), "type").distinct().orderBy("unit", "statement")


def statements(nodes: DataFrame, edges: DataFrame, procedure: str) -> DataFrame:
    """All statements below a procedure by start line; only what stands below it is walked."""
    below = graph.reached(edges, nodes.where(F.col("name") == procedure), up=False)
    return below.select(F.col("node").alias("node_id")).distinct().join(nodes, "node_id").orderBy("start_line", "node_id")


def describe(df: DataFrame, key: dict[str, str], text: str) -> tuple[DataFrame, int]:
    """df with the description of the rows with this key set by a user, and their number (0: not found)."""
    at = F.lit(True)
    for k, v in key.items():
        at = at & (F.col(k) == v)
    n = df.where(at).count()
    return df.withColumns({"description": F.when(at, text).otherwise(F.col("description")), "description_source": F.when(at, "user").otherwise(F.col("description_source"))}), n


STAR_COLUMN = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("dtype", T.StringType()), T.StructField("is_pk", T.BooleanType()), T.StructField("is_fk", T.BooleanType()), T.StructField("fk_table", T.StringType()), T.StructField("fk_column", T.StringType())]))


def star_tables(cube: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tables, columns, keys) of star schemas. cube: cube_name, schema_name, table_name, table_type, columns (STAR_COLUMN)."""
    tables = cube.select("cube_name", "schema_name", "table_name", "table_type", F.lower(F.concat_ws(".", "schema_name", "table_name")).alias("fqn"))
    each = cube.select("cube_name", "schema_name", "table_name", F.posexplode("columns").alias("ordinal", "c"))
    columns = each.select("cube_name", "schema_name", "table_name", F.col("c.name").alias("column_name"), "ordinal", F.col("c.dtype").alias("dtype"), F.col("c.is_pk").alias("is_pk"), F.col("c.is_fk").alias("is_fk"), F.lower(F.concat_ws(".", "schema_name", "table_name", "c.name")).alias("fqn"))
    keys = each.where(F.col("c.is_fk") & (F.coalesce("c.fk_table", F.lit("")) != "")).select("cube_name", F.col("table_name").alias("from_table"), F.col("c.name").alias("from_column"), F.col("c.fk_table").alias("to_table"), F.col("c.fk_column").alias("to_column"))
    return tables, columns, keys


def drop_cube(tables: DataFrame, columns: DataFrame, keys: DataFrame, cube: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The three tables of star schemas without one cube, and one row with the number of tables deleted."""
    gone = F.col("cube_name") == cube
    return tables.where(~gone), columns.where(~gone), keys.where(~gone), tables.where(gone).agg(F.countDistinct("fqn").alias("deleted"))


def existing_files(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """The asked files (directory, file) that have nodes already: an incremental run if there are any."""
    return asked.join(nodes, ["directory", "file"], "left_semi")


def resolve_calls(calls: DataFrame, units: DataFrame) -> DataFrame:
    """(src, dst, scope, is_new) of calls (directory, file, src, callee).

    A plain name is resolved in its file (internal), pkg.proc by the whole name (external); an external target that is
    unknown is created, an internal one dropped.
    """
    external = F.instr("callee", ".") > 0
    own = units.select("directory", "file", F.col("name").alias("callee"), F.col("node_id").alias("dst"))
    internal = calls.where(~external).join(own, ["directory", "file", "callee"]).select("src", "dst", F.lit("internal").alias("scope"), F.lit(False).alias("is_new"))
    every = units.groupBy(F.lower("name").alias("k")).agg(F.min("node_id").alias("found"))
    outer = calls.where(external).join(every, F.lower("callee") == F.col("k"), "left")
    made = F.sha2(F.concat_ws("\u0001", F.lit("PROCEDURE"), F.lower("callee")), 256)
    return internal.unionByName(outer.select("src", F.coalesce("found", made).alias("dst"), F.lit("external").alias("scope"), F.col("found").isNull().alias("is_new")))


def table_uses(dml: DataFrame, known: DataFrame, default: str = "public") -> DataFrame:
    """(src, schema_name, table_name, db_link, type) of what statements touch. dml: src, name (SCHEMA.TABLE@LINK), mode.

    Names are taken as the definitions write them (case ignored), first with their schema, then with the default one.
    """
    from ..functions.text import access_modes, table_identifier

    each = dml.select("src", table_identifier(F.col("name")).alias("t"), F.explode(access_modes(F.col("mode"))).alias("type"))
    each = each.withColumn("s", F.coalesce(F.nullif("t.schema", F.lit("")), F.lit(default)))
    names = known.groupBy(F.lower("schema_name").alias("ks"), F.lower("table_name").alias("kt")).agg(F.min(F.struct("schema_name", "table_name")).alias("k"))
    out = each.join(names, (F.lower("s") == F.col("ks")) & (F.lower("t.table") == F.col("kt")), "left")
    return out.select("src", F.coalesce("k.schema_name", "s").alias("schema_name"), F.coalesce("k.table_name", "t.table").alias("table_name"), F.col("t.db_link").alias("db_link"), F.when(F.col("t.db_link").isNotNull(), "DB_LINK").otherwise(F.col("type")).alias("type")).distinct()


def column_uses(uses: DataFrame, known: DataFrame) -> DataFrame:
    """uses (schema_name, table_name, column_name, ...) with columns named as the definitions write them.

    The same spelling comes first, then one that differs in case only (the least of several); an unknown column keeps its name.
    """
    names = known.select(F.lower("schema_name").alias("_s"), F.lower("table_name").alias("_t"), F.lower("column_name").alias("_c"), F.col("column_name").alias("_name")).distinct()
    found = names.groupBy("_s", "_t", "_c").agg(F.array_sort(F.collect_set("_name")).alias("_names"))
    at = uses.join(found, (F.lower("schema_name") == F.col("_s")) & (F.lower("table_name") == F.col("_t")) & (F.lower("column_name") == F.col("_c")), "left")
    name = F.when(F.array_contains("_names", F.col("column_name")), F.col("column_name")).otherwise(F.coalesce(F.get("_names", F.lit(0)), F.col("column_name")))
    return at.withColumn("column_name", name).drop("_s", "_t", "_c", "_names")


def summarise_uses(rows: DataFrame) -> DataFrame:
    """Per column what its uses say: the first descriptions, the first type, the last nullability, up to five examples.

    rows: schema_name, table_name, column_name, seq, description, dtype, nullable, example. Descriptions are the first
    DESCRIPTIONS different ones in order. Each task cuts both lists off before anything is shuffled.
    """
    at = ["schema_name", "table_name", "column_name"]
    text = lambda c: F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.trim(c))
    one = rows.groupBy(*at).agg(F.min_by(text("dtype"), F.when(text("dtype").isNotNull(), F.col("seq"))).alias("dtype"), F.max_by("nullable", F.when(F.col("nullable").isNotNull(), F.col("seq"))).alias("nullable"))
    for name, c, n in (("descriptions", "description", DESCRIPTIONS), ("examples", "example", EXAMPLES)):
        first = first_rows(rows.select(*at, text(c).alias("x")).where("x IS NOT NULL"), at, ["x"], n).groupBy(*at).agg(F.sort_array(F.collect_list("x")).alias(name))
        first = first.select(*(F.col(k).alias(f"_{k}") for k in at), name)
        one = one.join(first, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in at)), "left").drop(*(f"_{k}" for k in at))
        one = one.withColumn(name, F.coalesce(name, F.expr("cast(array() AS array<string>)")))
    return one.select(*at, "descriptions", "dtype", "nullable", "examples")
