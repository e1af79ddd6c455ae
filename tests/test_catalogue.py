"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from terncove.plans import catalogue

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in catalogue.TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    v = v.item() if hasattr(v, "item") else v
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v if isinstance(v, (str, bool)) else str(v)


def rows(frame, columns):
    return sorted(([plain(x) for x in r] for r in frame[columns].values.tolist()), key=lambda r: [(x is not None, str(x)) for x in r])


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DIR).toPandas()
    if name not in catalogue.ORACLE:
        assert len(got.columns)
        return
    want = duck.execute(catalogue.ORACLE[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(want, columns)


def test_entry(spark):
    assert catalogue.flagship(spark, DIR).columns == ["category", "n", "with_phone", "with_email"]
