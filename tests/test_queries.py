"""Every registered query of the engine against its SQL in DuckDB, over the smallest tables."""

from __future__ import annotations

import numbers
import os

import duckdb
import pandas as pd
import pytest

from lorespark import registry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    def one(x: object) -> str:
        if hasattr(x, "__len__") and not isinstance(x, str):
            return str([str(y) for y in x])
        if x is None or pd.isna(x):
            return "NULL"
        # counts with nulls among them are floats in one frame and integers in the other
        return repr(round(float(x), 6) + 0.0) if isinstance(x, numbers.Number) and "bool" not in type(x).__name__ else str(x)

    return sorted(tuple(one(x) for x in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_queries_without_sql_are_those_of_test_plain():
    assert set(QUERIES) - set(ORACLES) == {"n1_html_units", "n2_chunks", "n2_text_chunks", "t11_mmr", "v12_neural_rerank", "v13_route_targets", "x4_coalesce_requests"}


def test_no_query_without_a_function():
    assert set(ORACLES) <= set(QUERIES)
