"""Each imaging query against its SQL."""

import duckdb
import pandas as pd
import pytest

from lamina.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in ("supplier", "part", "orders", "lineitem", "events", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sql, name):
    mine = QUERIES[name](spark, SF).toPandas()
    assert len(mine)
    if name in ORACLE_SQL:
        other = sql.execute(ORACLE_SQL[name]).fetchdf()
        columns = sorted(mine)
        a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (mine, other))
        pd.testing.assert_frame_equal(a, b, check_exact=True)
