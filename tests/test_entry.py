import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_point
from vellum.plans import catalog

SF = "/root/testdata/sf0.001"


def plain(frame):
    columns = sorted(frame.columns)

    def one(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return ""
        return repr(round(float(v), 6)) if isinstance(v, float) else str(int(v)) if isinstance(v, (bool, int)) else str(v)

    return sorted(tuple(one(v) for v in row) for row in frame[columns].itertuples(index=False)), columns


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def test_names():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_oracle(spark, duck, name):
    own = catalog.QUERIES[name](spark, SF)
    result = duck.execute(catalog.ORACLE_SQL[name])
    theirs = pd.DataFrame(result.fetchall(), columns=[c[0] for c in result.description], dtype=object)
    ours = pd.DataFrame([tuple(r) for r in own.collect()], columns=own.columns, dtype=object)
    assert plain(ours) == plain(theirs)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
