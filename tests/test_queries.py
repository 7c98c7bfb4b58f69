"""Every registered query equals its SQL on the smallest tables."""

import check_queries
import pytest

import __spark_entry__ as entry
from codeloom.queries import registry

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return check_queries.connect(SF_DIR)


def test_every_query_has_sql():
    # Cells are fitted, so this one has no SQL; test_search.py measures its recall.
    assert set(registry.QUERIES) - {"vector_index_search"} == set(registry.ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    assert check_queries.compare(spark, duck, SF_DIR, name).startswith("ok")


def test_entry_is_the_flagship_search(spark):
    rows = entry.entry(spark).collect()
    assert [(r["id"], round(r["score"], 6)) for r in rows[:3]][0] == (0, 0.0)
    assert len(rows) == 10
