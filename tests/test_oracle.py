"""Every registered query against its SQL text on DuckDB (sf0.001)."""
import os

import duckdb
import pytest

from sf_paths import SF_SMALL

import __spark_entry__ as entry
from tools.oracle_check import TABLES, rows_key

ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF_SMALL)
    srows, scols = [tuple(r) for r in df.collect()], df.columns
    cur = con.execute(ORACLE[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(scols) == sorted(dcols)
    assert rows_key(scols, srows) == rows_key(dcols, drows)


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == spark.read.parquet(f"{SF_SMALL}/customer.parquet").count()
    assert set(df.columns) >= {"c_custkey", "TARGET", "prob1"}
