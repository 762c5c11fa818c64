import pytest

from mosaiq.plans.registry import all_queries
from tests.oracle import SF, same


@pytest.mark.parametrize("name", [n for n, q in all_queries().items() if q.sql])
def test_same_as_sql(spark, name):
    q = all_queries()[name]
    same(q.run(spark, SF), q.sql)


@pytest.mark.parametrize("name", [n for n, q in all_queries().items() if not q.sql])
def test_gives_rows(spark, name):
    assert all_queries()[name].run(spark, SF).count() > 0
