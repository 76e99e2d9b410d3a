"""Every query with an oracle gives DuckDB's rows at the smallest scale; the rest run."""

from numbers import Number

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = {n: s for n, s in entry.oracle_sql().items() if not n.startswith("op")}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list:
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or v != v:
            return None
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        return float(v) if isinstance(v, Number) else str(v)

    return sorted((tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    got, want = canonical(entry.queries()[name](spark, SF).toPandas()), canonical(duck.sql(ORACLES[name]).df())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-6) for x, y in zip(a, b)), (a, b)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "team1_goals_for_roll5" in df.columns


def test_flagship_plan_prunes_columns(spark):
    plan = entry.entry(spark)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "CartesianProduct" not in plan
