"""Every registered query against its SQL on DuckDB, and completeness of the inventory."""

import pytest

from quotegrid.workloads.catalog import ORACLE, QUERIES
from tools.check import compare, oracle_connection

GROUPS = {"src": 10, "flt": 25, "jon": 14, "agg": 22, "win": 22, "top": 8, "set": 4, "sca": 14, "rsh": 5, "mod": 38, "dq": 23}


def test_every_inventory_row_has_a_query():
    wanted = {f"{g}{i:02d}" for g, n in GROUPS.items() for i in range(1, n + 1)}
    have = {name.split("_")[0] for name in QUERIES}
    assert wanted <= have, sorted(wanted - have)


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)


@pytest.fixture(scope="module")
def duck(sf):
    return oracle_connection(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, duck, sf, name):
    rows, note = compare(spark, duck, sf, QUERIES[name], ORACLE.get(name))
    assert note is None, note


def test_entry_returns_rows(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.limit(1).count() == 1
    assert set(ORACLE) <= set(entry.oracle_sql()) <= set(entry.queries())
