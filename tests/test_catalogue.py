"""Every registered query of the recipe engine against its SQL, on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from brigade.plans import catalogue
from brigade.plans.synthetic import TABLES

SF = "/root/testdata/sf0.001"


def rows(frame):
    cols = sorted(frame.columns)
    plain = lambda x: None if pd.isna(x) else float(x) if isinstance(x, (int, float, np.number)) and not isinstance(x, (bool, np.bool_)) else str(x)
    return cols, sorted([tuple(plain(x) for x in r) for r in frame[cols].astype(object).itertuples(index=False)], key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_sql(spark, duck, name):
    assert rows(entry.queries()[name](spark, SF).toPandas()) == rows(duck.sql(entry.oracle_sql()[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
