"""Every query with SQL gives the SQL's rows on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tessel import catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob(DATA + "/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f + ('/*.parquet' if os.path.isdir(f) else '')}'")
    return c


def rows(frame):
    def text(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return "-"
        if "float" in type(v).__name__:
            return f"{v:.9g}"
        return str(bool(v)) if type(v).__name__ in ("bool", "bool_") else str(v)

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted("|".join(map(text, r)) for r in frame.itertuples(index=False, name=None))


def same_numbers(a, b):
    return [x.replace(".0|", "|") for x in a] == [x.replace(".0|", "|") for x in b]


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_oracle(spark, db, name):
    got, want = catalogue.queries()[name](spark, DATA).toPandas(), db.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a = rows(got.convert_dtypes())
    b = rows(want.convert_dtypes())
    assert a == b


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_without_oracle_runs(spark, name):
    assert catalogue.queries()[name](spark, DATA).count() > 0
