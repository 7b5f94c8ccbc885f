"""Code texts made from the driver's tables, so that operators on code run over as many rows as the data has.

What they must give follows from the same tables; the SQL for it stands beside the other oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, content): a table for each supplier in a schema for its nation, with comments and keys; every third refers to a table that isn't defined."""
    text = r"""concat('CREATE TABLE N', s_nationkey, '."S', s_suppkey, '" (\n  ID INTEGER NOT NULL,\n  AMOUNT NUMBER(10,', s_suppkey % 5, '),\n  REF_ID INTEGER\n);\n',
      'COMMENT ON TABLE N', s_nationkey, '."S', s_suppkey, '" IS ''it''''s ', s_name, ''';\n', 'COMMENT ON COLUMN N', s_nationkey, '."S', s_suppkey, '"."AMOUNT" IS ''amount ', s_suppkey, ''';\n',
      'ALTER TABLE N', s_nationkey, '.S', s_suppkey, ' ADD CONSTRAINT pk', s_suppkey, ' PRIMARY KEY (ID);\n',
      'alter table N', s_nationkey, '.S', s_suppkey, ' add foreign key (REF_ID) references N', s_nationkey, if(s_suppkey % 3 = 0, concat('.OTHER', s_nationkey), concat('.S', s_suppkey)), ' (ID);\n')"""
    return _t(spark, sf_dir, "supplier").select(F.expr("concat('s', s_suppkey, '.sql')").alias("file"), F.expr(text).alias("content"))


def uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, name, mode): what statements touch, as they spell it: a defined table, one behind a link, an unknown one."""
    name = "CASE s_suppkey % 3 WHEN 0 THEN concat('n', s_nationkey, '.s', s_suppkey) WHEN 1 THEN concat('N', s_nationkey, '.\"S', s_suppkey, '\"@far') ELSE concat('ghost', s_suppkey) END"
    return _t(spark, sf_dir, "supplier").select(F.expr("concat('u', s_suppkey)").alias("src"), F.expr(name).alias("name"), F.expr("element_at(array('r', 'w', 'rw'), cast(s_suppkey % 3 AS int) + 1)").alias("mode"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, name): names of tables in six spellings."""
    name = """CASE c_custkey % 6 WHEN 0 THEN concat('"N', c_nationkey, '"."C', c_custkey, '"@L', c_nationkey) WHEN 1 THEN concat('n', c_nationkey, '.c', c_custkey, '.x') WHEN 2 THEN concat('[N', c_nationkey, '].[C', c_custkey, ']')
      WHEN 3 THEN concat('`N', c_nationkey, '`.`C', c_custkey, '`') WHEN 4 THEN concat(' N', c_nationkey, ' . C', c_custkey, ' ') ELSE concat('C', c_custkey, '@l') END"""
    return _t(spark, sf_dir, "customer").select((F.col("c_custkey") + 100).alias("i"), F.expr(name).alias("name"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, path): folders with a known schema, two of them or none."""
    path = r"CASE c_custkey % 4 WHEN 0 THEN concat('app/SALES/n', c_nationkey) WHEN 1 THEN concat('app\\dw\\x', c_custkey) WHEN 2 THEN concat('x/y', c_nationkey) ELSE '/dw/sales/z/' END"
    return _t(spark, sf_dir, "customer").select((F.col("c_custkey") + 100).alias("i"), F.expr(path).alias("path"))


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, code): heads of procedures with a schema, a number before them, a package or no name."""
    code = "CASE c_custkey % 4 WHEN 0 THEN concat('CREATE OR REPLACE PROCEDURE N', c_nationkey, '.P', c_custkey, ' IS') WHEN 1 THEN concat(c_custkey, ': create function f', c_custkey, '(x int)') WHEN 2 THEN concat('PROCEDURE a', c_nationkey, ' . b.\"c', c_custkey, '\"') ELSE concat('begin x', c_custkey, '; end;') END"
    return _t(spark, sf_dir, "customer").select((F.col("c_custkey") + 100).alias("i"), F.expr(code).alias("code"))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit_id, code): a statement for each order that reads two tables and writes one."""
    code = "concat('12: INSERT INTO dw.f', o_custkey % 7, ' SELECT * FROM stg.s', o_orderkey % 11, ' a -- FROM hidden', '\\n', '13: JOIN stg.c', o_custkey % 5, ' b ON a.id = b.id /* JOIN no */;')"
    return _t(spark, sf_dir, "orders").select(F.expr("concat('o', o_orderkey)").alias("unit_id"), F.expr(code).alias("code"))


def _order_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, m). The rows are small, the files made from them are not: dealt anew, or few tasks would make and parse all files."""
    m = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("int").alias("m"))
    return m.repartition(4 * spark.sparkContext.defaultParallelism, "l_orderkey")


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(directory, file, content): a parsed file for each order, with a procedure that has a statement of two lines for each of its lines."""
    m = _order_sizes(spark, sf_dir)
    child = "named_struct('type', if(i % 2 = 0, 'IF', 'UPDATE'), 'startLine', 2 * i, 'endLine', 2 * i + 1, 'code', concat(2 * i, ': UPDATE T', i, '\\r\\n', 2 * i + 1, ': SET x'), 'children', cast(array() AS array<string>))"
    unit = f"named_struct('type', 'PROCEDURE', 'name', concat('P', l_orderkey), 'startLine', 1, 'endLine', 2 * m + 2, 'code', concat('1: CREATE PROCEDURE P', '\\r\\n', array_join(transform(sequence(1, m), i -> concat(2 * i, ': UPDATE T', i, '\\r\\n', 2 * i + 1, ': SET x')), '\\r\\n'), '\\r\\n', 2 * m + 2, ': END;'), 'children', transform(sequence(1, m), i -> {child}))"
    content = f"to_json(named_struct('type', 'FILE', 'startLine', 1, 'endLine', 2 * m + 2, 'code', '', 'children', array({unit})))"
    return m.select(F.lit("d").alias("directory"), F.expr("concat(l_orderkey, '.sql')").alias("file"), F.expr(content).alias("content"))


def deep_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(directory, file, content): a parsed file for each order, with a loop, in it a branch for each of its lines, in each an update and a query."""
    m = _order_sizes(spark, sf_dir)
    inner = "concat(6 * i - 2, ': UPDATE T', l_orderkey % 50, '\\n', 6 * i - 1, ': SET x = ', i), concat(6 * i, ': SELECT ', i, '\\n', 6 * i + 1, ': FROM S', i % 3)"
    leaf = lambda kind, start, code: f"named_struct('type', '{kind}', 'startLine', {start}, 'endLine', {start} + 1, 'code', {code}, 'children', cast(array() AS array<string>))"
    update, select = inner.split("), concat(")
    branch = f"concat(6 * i - 3, ': IF ', i, ' THEN\\n', {update}), '\\n', concat({select}, '\\n', 6 * i + 2, ': END IF;')"
    children = f"array({leaf('UPDATE', '6 * i - 2', update + ')')}, {leaf('SELECT', '6 * i', 'concat(' + select)})"
    branches = f"transform(sequence(1, m), i -> named_struct('type', 'IF', 'startLine', 6 * i - 3, 'endLine', 6 * i + 2, 'code', {branch}, 'children', {children}))"
    lines = f"array_join(transform(sequence(1, m), i -> {branch}), '\\n')"
    loop = f"named_struct('type', 'LOOP', 'startLine', 2, 'endLine', 6 * m + 3, 'code', concat('2: FOR r IN (SELECT * FROM F', l_orderkey % 4, ') LOOP\\n', {lines}, '\\n', 6 * m + 3, ': END LOOP;'), 'children', {branches})"
    unit = f"named_struct('type', 'PROCEDURE', 'name', concat('P', l_orderkey), 'startLine', 1, 'endLine', 6 * m + 4, 'code', concat('1: PROCEDURE P\\n2: FOR r IN (SELECT * FROM F', l_orderkey % 4, ') LOOP\\n', {lines}, '\\n', 6 * m + 3, ': END LOOP;\\n', 6 * m + 4, ': END;'), 'children', array({loop}))"
    content = f"to_json(named_struct('type', 'FILE', 'startLine', 1, 'endLine', 6 * m + 4, 'code', '', 'children', array({unit})))"
    return m.select(F.lit("d").alias("directory"), F.expr("concat(l_orderkey, '.sql')").alias("file"), F.expr(content).alias("content"))


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(directory, file, content): a parsed file for each supplier, with a class that extends its nation's, has a field, a method and a variable of other classes; and those."""
    code = r"concat('1: public class S', k, ' extends B', n, ' {\n2:   private P', k % 7, ' part = new P', k % 7, '();\n3:   public Q', k % 5, ' make(R', k % 3, ' r, int n) {\n4:     T', k % 4, ' t = new T', k % 4, '();\n5:     part.run(n);\n6:     return null;\n7:   }\n8: }')"
    method = r"concat('3:   public Q', k % 5, ' make(R', k % 3, ' r, int n) {\n4:     T', k % 4, ' t = new T', k % 4, '();\n5:     part.run(n);\n6:     return null;\n7:   }')"
    none = "cast(array() AS array<string>)"
    field = f"named_struct('type', 'FIELD', 'name', 'part', 'startLine', 2, 'endLine', 2, 'code', concat('2:   private P', k % 7, ' part = new P', k % 7, '();'), 'children', {none})"
    body = f"named_struct('type', 'METHOD', 'name', 'make', 'startLine', 3, 'endLine', 7, 'code', {method}, 'children', {none})"
    unit = f"named_struct('type', 'CLASS', 'name', concat('S', k), 'startLine', 1, 'endLine', 8, 'code', {code}, 'children', array({field}, {body}))"
    plain = f"named_struct('type', 'CLASS', 'name', c, 'startLine', 1, 'endLine', 2, 'code', concat('1: class ', c, ' {{\\n2: }}'), 'children', {none})"
    file = "to_json(named_struct('type', 'FILE', 'startLine', 1, 'endLine', 8, 'code', '', 'children', array({})))"
    own = _t(spark, sf_dir, "supplier").selectExpr("s_suppkey AS k", "s_nationkey AS n")
    # those which all suppliers together name
    others = own.selectExpr("explode(array(concat('B', n), concat('P', k % 7), concat('Q', k % 5), concat('R', k % 3), concat('T', k % 4))) AS c").distinct()
    at = lambda df, name, x: df.select(F.lit("d").alias("directory"), F.expr(f"concat({name}, '.java')").alias("file"), F.expr(file.format(x)).alias("content"))
    return at(own, "concat('S', k)", unit).unionByName(at(others, "c", plain))


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(from_table, from_column, to_table, to_column, source): a table for each supplier that refers to its nation's, and those to their region's."""
    own = _t(spark, sf_dir, "supplier").selectExpr("concat('S', s_suppkey) AS from_table", "'nation_id' AS from_column", "concat('N', s_nationkey) AS to_table", "'id' AS to_column", "if(s_suppkey % 2 = 0, 'user', 'ddl') AS source")
    return own.union(_t(spark, sf_dir, "nation").selectExpr("concat('N', n_nationkey)", "'region_id'", "concat('R', n_regionkey)", "'id'", "'ddl'"))


def unit_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit, table_name, type): an order as a unit that reads the tables of its suppliers and their nations."""
    at = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    both = F.explode(F.array(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")), F.concat(F.lit("N"), F.col("s_nationkey").cast("string"))))
    return at.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("unit"), both.alias("table_name"), F.lit("FROM").alias("type"))


def procedures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, content): a file for each supplier with a procedure that fills a table from two and empties a third, and one that only writes."""
    text = r"concat('CREATE OR REPLACE PROCEDURE p', s_suppkey, ' AS\nBEGIN\n INSERT INTO dw.f', s_suppkey % 7, '\n SELECT * FROM stg.s', s_suppkey, ' s JOIN ref.n', s_nationkey, ' r ON r.id = s.n;\n DELETE FROM log.l', s_suppkey % 3, ';\nEND;\nCREATE PROCEDURE q', s_suppkey, ' IS\nBEGIN\n UPDATE dw.g', s_suppkey % 5, ' SET x = 1;\nEND;')"
    return _t(spark, sf_dir, "supplier").select(F.expr("concat('p', s_suppkey, '.sql')").alias("file"), F.expr(text).alias("content"))


def temporaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit_id, kind, code): statements that make temporary tables, one of three of another kind."""
    code = "CASE s_suppkey % 3 WHEN 0 THEN concat('1: create global temporary table W', s_nationkey, '.T', s_suppkey, ' (x int);') WHEN 1 THEN concat('CREATE TEMP TABLE IF NOT EXISTS t', s_suppkey, ' AS SELECT 1') ELSE concat('create temp table u', s_suppkey, ' (x int)') END"
    return _t(spark, sf_dir, "supplier").select(F.expr("concat('s', s_suppkey)").alias("unit_id"), F.expr("if(s_suppkey % 3 = 2, 'INSERT', 'CREATE_TEMP_TABLE')").alias("kind"), F.expr(code).alias("code"))


def class_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, name): names of classes: of the data, of a few letters, of the platform."""
    name = "CASE c_custkey % 6 WHEN 0 THEN concat('Order', c_custkey) WHEN 1 THEN concat('x', c_custkey % 50) WHEN 2 THEN 'List' WHEN 3 THEN concat('order', c_custkey) WHEN 4 THEN concat('aB', c_custkey % 100) ELSE 'Logger' END"
    return _t(spark, sf_dir, "customer").select((F.col("c_custkey") + 100).cast("int").alias("i"), F.expr(name).alias("name"))


def glossary(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(glossaries, terms, links): a glossary for each nation, a term for each supplier in its nation's, with a domain and an owner, some with tags."""
    nation, supplier = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "supplier")
    glossaries = nation.selectExpr("cast(n_nationkey AS int) AS glossary_id", "n_name AS name", "if(n_nationkey % 3 = 0, 'Technical', NULL) AS type")
    terms = supplier.selectExpr("cast(s_suppkey AS int) AS term_id", "cast(s_nationkey AS int) AS glossary_id", "s_name AS name", "cast(NULL AS string) AS description", "if(s_suppkey % 4 = 0, 'Approved', NULL) AS status")
    link = "explode(array_compact(array(struct('BELONGS_TO_DOMAIN' AS type, concat('D', s_suppkey % 5) AS target), struct('OWNED_BY' AS type, concat('O', s_suppkey % 7) AS target), if(s_suppkey % 2 = 0, struct('HAS_TAG' AS type, concat('t', s_suppkey % 3) AS target), NULL), if(s_suppkey % 2 = 0, struct('HAS_TAG' AS type, 'even' AS target), NULL)))) AS x"
    return glossaries, terms, supplier.selectExpr("cast(s_suppkey AS int) AS term_id", link).select("term_id", "x.type", "x.target")
