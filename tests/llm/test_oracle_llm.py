"""The corpus queries against their SQL on DuckDB, over whole tables."""

import os

import duckdb
import pytest
from conftest import DATA
from test_oracle import TABLES, TYPES, _table

from newsloom.llm.queries import QUERIES, SQL

SF = os.environ.get("ORACLE_SF", "sf0.01")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{SF}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, f"{DATA}/{SF}")
    ours = _table(df.columns, map(tuple, df.collect()))
    cursor = duck.execute(SQL[name])
    theirs = _table([c[0] for c in cursor.description], cursor.fetchall())
    assert ours == theirs and ours[1]
    described = duck.execute(f"DESCRIBE {SQL[name]}").fetchall()
    kinds = TYPES | {"BOOLEAN": "boolean"}
    assert dict(df.dtypes) == {row[0]: kinds.get(row[1], row[1]) for row in described}


@pytest.mark.parametrize("name", ["op1_line_templates", "op5_bloom_dedup"])
def test_native_plans_have_no_python(spark, name):
    plan = QUERIES[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
