"""Every catalog query with a DuckDB twin gives its rows on the smallest tables."""
import pytest
from oracle import connection, difference

from cellgrove.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection(SF)


def test_twins_have_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_twin(spark, con, name):
    assert difference(QUERIES[name](spark, SF), SQL[name], con) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_twin_gives_numbers(spark, name):
    """Rows, no row twice, numbers that are finite; what they must be is tested in test_micro."""
    rows = QUERIES[name](spark, SF).collect()
    # no group of these small tables has more samples than pruning keeps
    assert (rows or name == "prune_samples") and len(set(rows)) == len(rows)
    for r in rows:
        assert all(v == v and abs(v) != float("inf") for v in r if isinstance(v, float))


def test_flagship(spark):
    assert catalog.flagship(spark, SF).count() > 0


def test_entry_module_imports():
    import __spark_entry__

    assert set(catalog.queries()) <= set(__spark_entry__.queries())
