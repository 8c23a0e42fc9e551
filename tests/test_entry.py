"""Registered queries against their SQL on the smallest tables."""

import glob
import math
import os

import pytest

from linequarry.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows(df):
    def plain(x):
        return "null" if x is None or isinstance(x, float) and math.isnan(x) else f"{float(x):.9g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    cols = sorted(df.columns)
    return cols, sorted(tuple(plain(v.item() if hasattr(v, "item") else v) for v in r) for r in df[cols].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf_dir, duck, name):
    assert rows(QUERIES[name](spark, sf_dir).toPandas()) == rows(duck.execute(ORACLE[name]).df())


def test_entry(spark, sf_dir):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["doc_id", "line", "column", "preview"]
    assert set(e.oracle_sql()) <= set(e.queries())
