"""The driver's contract, and queries against their SQL on small tables."""

import os
import re

import pytest

import __spark_entry__ as contract

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


def test_every_sql_has_its_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    numbers = {int(m[1]) for q in contract.queries() if (m := re.match(r"p(\d+)_", q))}
    assert numbers >= set(range(1, 8))


@needs_data
def test_entry(spark):
    assert contract.entry(spark).columns == ["db_table", "name", "from_utc", "until_utc"]


@needs_data
@pytest.mark.parametrize("name", ["p3_found", "p4_found", "p7_found", "scd_history", "interlace_two", "join_full_mixed", "delta_open", "snapshot_difference"])
def test_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    got = contract.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    sql = contract.oracle_sql()[name]
    want = c.execute(f"SELECT {', '.join(columns)} FROM ({sql}) AS q").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, want))
