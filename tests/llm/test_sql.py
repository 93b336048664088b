import glob
import os

import pytest
from noteweave.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_queries_equal_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, SF)
        columns = sorted(df.columns)
        want = con.execute(f"select {', '.join(columns)} from ({sql})").fetchall()
        assert sorted(map(str, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(str, want)), name
