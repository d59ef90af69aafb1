"""Driver contract and a DuckDB cross-check of every query with a twin at sf0.001."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import TABLES, rows_of  # noqa: E402


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns[0] == "date" and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


FAST = ["energies_build", "rollup_consumption_day", "rollup_production_15min", "report_daily",
        "contract_join", "energy_fee_dispatch", "energies_upsert", "wide_consumptions",
        "src_payload_roundtrip", "src_strict_reject"]


@pytest.mark.parametrize("name", FAST)
def test_matches_duckdb(spark, sf_small, name):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_small}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    sdf = E.queries()[name](spark, sf_small)
    cur = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert rows_of(sdf.columns, [tuple(r) for r in sdf.collect()], True) == rows_of(dcols, cur.fetchall(), True)
