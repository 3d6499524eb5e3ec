"""Driver contract: entry(), queries() and oracle_sql() agree; a sample of
queries matches DuckDB on the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as E
from quarry.sources.fixtures import TABLES
from tools.oracle_check import _rows

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and df.columns == ["location", "avg_calibrated", "max_calibrated"]


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", ["sensor_detailed", "reading_rank", "run_report", "calls_dedup",
                                  "io_inventory", "normalized_source", "inline_call_sites"])
def test_query_matches_duckdb(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    sdf = E.queries()[name](spark, SF)
    cur = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert _rows(sdf.columns, [tuple(r) for r in sdf.collect()]) == _rows(dcols, cur.fetchall())
