"""Spark vs DuckDB parity for the headline queries (the full gate is
scripts/oracle_check.py): same column names and the same multiset of rows."""

import duckdb
import pytest

from paths import SF01
from vigil.sources.tables import TABLES

NAMES = ["hotspots", "analysis_summary", "risk_amplifiers", "recommendations", "validation_run",
         "location_extract", "recent_effectiveness_latest", "spike_alerts", "analysis_json"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF01}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_parity(spark, duck, name):
    import __spark_entry__ as E
    sdf = E.queries()[name](spark, SF01)
    res = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(dcols)
    order = sorted(dcols)
    s_rows = sorted((tuple(r[c] for c in order) for r in sdf.collect()), key=repr)
    d_rows = sorted((tuple(dict(zip(dcols, r))[c] for c in order) for r in res.fetchall()), key=repr)
    assert s_rows == d_rows
