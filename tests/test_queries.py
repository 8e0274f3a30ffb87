import pytest
from compare import DATA, same

from tidemark.plans import catalogue


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query_gives_what_its_sql_gives(spark, name):
    if name in catalogue.ORACLES:
        same(catalogue.QUERIES[name](spark, DATA), catalogue.ORACLES[name])
    else:
        assert catalogue.QUERIES[name](spark, DATA).count() > 0


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
