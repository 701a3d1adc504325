import pytest

from casework.plans.registry import ORACLE_SQL, QUERIES
from tests.oracle import difference


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert not difference(df, ORACLE_SQL[name], sf_dir)
    assert df.count() > 0
