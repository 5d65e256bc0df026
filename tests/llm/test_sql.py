import os

import duckdb
import pandas as pd
import pytest

from tests.test_entry import SF, plain
from vellum.llm import catalog


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    result = con.execute(catalog.ORACLE_SQL[name])
    theirs = pd.DataFrame(result.fetchall(), columns=[c[0] for c in result.description], dtype=object)
    own = catalog.QUERIES[name](spark, SF)
    ours = pd.DataFrame([tuple(r) for r in own.collect()], columns=own.columns, dtype=object)
    assert plain(ours) == plain(theirs)
