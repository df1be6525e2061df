"""Every registered query against its DuckDB oracle on the sf0.01 tables (the driver's gate)."""

import pytest

from conftest import SF001
from oracle_harness import compare, duck

import __spark_entry__ as entry

def load_all_names():
    """Queries of the library itself; the training-data subpackage has its own tests."""
    from ashgrid.plans import load_all
    from ashgrid.plans.catalog import QUERIES
    load_all()
    return sorted(QUERIES)


NAMES = load_all_names()


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


def test_every_query_has_an_oracle_or_is_rows_only():
    rows_only = set(load_all_names()) - set(entry.oracle_sql())
    assert rows_only == set()


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    r = compare(name, spark, SF001, con)
    assert r["status"] in ("match", "rows-only"), r
    assert not r["nested_loop"], f"{name} plans a nested-loop join or Cartesian product"
    assert not r.get("type_mismatches"), r["type_mismatches"]


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "source"
    assert len(df.collect()) == 2
