"""Every registered query against its DuckDB counterpart on the smallest test data."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test data not present")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return (0, "")
        if isinstance(x, bool):
            return (1, int(x))
        return (2, float(x)) if isinstance(x, (int, float)) else (3, str(x))

    return sorted([tuple(value(row[i]) for i in order) for row in rows])


def test_every_oracle_has_a_query():
    optional = {n for n in entry.queries() if n == "pipeline" or n.startswith("op")}
    assert set(entry.oracle_sql()) - optional == set(entry.queries()) - optional
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, str(DATA))
    result = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(got.columns) == sorted(columns)
    assert canonical(got.collect(), got.columns) == canonical(result.fetchall(), columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_terms_are_embedded_once_and_in_all_tasks(spark, tmp_path):
    part = [(i, f"part {i % 3}", "Brand#1", "TYPE") for i in range(6)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(
        f"{tmp_path}/part.parquet")
    line = spark.range(12).selectExpr(
        "id l_orderkey", "id % 6 l_partkey", "1 l_linenumber", "0.0D l_extendedprice", "0.0D l_discount",
        "0.0D l_tax", "'N' l_returnflag", "timestamp_ntz'1996-01-01 00:00:00' l_shipdate")
    line.write.parquet(f"{tmp_path}/lineitem.parquet")
    out = entry.queries()["embed_terms"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1
    assert plan.index("md5(") < plan.index("Repartition") < plan.index("Aggregate")
    assert out.count() == 3 * 64
