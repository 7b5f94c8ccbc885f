"""Every query of the entry module against its SQL in DuckDB, on the smallest tables."""

import glob

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tracewright import oracles, queries


@pytest.fixture(scope="session")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {f.split('/')[-1].removesuffix('.parquet')} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_sql(spark, sf, duck, tmp_path, name):
    queries.QUERIES[name](spark, sf).write.parquet(str(tmp_path / "out"))
    got = duck.sql(f"SELECT * FROM '{tmp_path}/out/*.parquet'")
    if name not in oracles.ORACLE_SQL:
        assert len(got.columns) > 0
        return
    want = duck.sql(oracles.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    names = ", ".join(f'"{c}"' for c in columns)
    a, b = f"SELECT {names} FROM got", f"SELECT {names} FROM want"
    assert duck.sql(f"({a} EXCEPT ALL {b}) UNION ALL ({b} EXCEPT ALL {a})").fetchall() == []


def test_more_terms_than_a_page(spark, sf, duck, tmp_path):
    """the query gives every supplier's term, not the first hundred."""
    supplier = spark.read.parquet(f"{sf}/supplier.parquet")
    many = supplier.crossJoin(spark.range(60).withColumnRenamed("id", "copy")).withColumn("s_suppkey", F.col("s_suppkey") + 1000 * F.col("copy")).select(supplier.columns)
    spark.read.parquet(f"{sf}/nation.parquet").write.parquet(f"{tmp_path}/nation.parquet")
    many.write.parquet(f"{tmp_path}/supplier.parquet")
    out = queries.glossary_terms(spark, str(tmp_path)).toArrow()
    want = duck.sql(oracles.ORACLE_SQL["glossary_terms"].replace("FROM supplier", f"FROM '{tmp_path}/supplier.parquet/*.parquet'")).to_arrow_table()
    as_set = lambda t: sorted(map(str, t.to_pylist()))
    assert out.num_rows == many.count() > 100 and as_set(out) == as_set(want)


def test_descriptions_name_every_nation(spark, tmp_path):
    """F8: a table that all 25 nations read and write is described with all their names."""
    names = [f"NATION {i:02}" for i in range(25)]
    spark.createDataFrame(list(enumerate(names)), "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    spark.range(50).selectExpr("id AS s_suppkey", "cast(id % 25 AS int) AS s_nationkey", "-1D AS s_acctbal").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {r.table_name: r.analysed_description for r in queries.described_tables(spark, str(tmp_path)).collect()}
    assert got == {"debt": f"read by {', '.join(names)}; written by {', '.join(names)}", "credit": None, "unused": None}


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
