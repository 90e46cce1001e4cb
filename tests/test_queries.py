import pytest

from quillstream.plans import catalog
from tests.oracle import SF, connect, rows_of, rows_of_sql


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, con, name):
    assert rows_of(catalog.queries()[name](spark, SF)) == rows_of_sql(con, catalog.oracle_sql()[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["doc_id", "rrf", "n_modes", "confidence"]
    assert set(e.oracle_sql()) <= set(e.queries())
