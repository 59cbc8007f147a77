import pytest
from compare import same

from riskloom.plans.queries import ORACLE_SQL, QUERIES


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_twin(spark, duck, small, name):
    same(QUERIES[name](spark, small), duck, ORACLE_SQL[name])


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert {"risk_level", "n"} == set(entry.entry(spark).columns)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())
