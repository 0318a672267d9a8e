import pytest

from tessel.llm.queries import ORACLE_SQL, QUERIES

from ..compare import compare


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_same_as_sql(spark, name):
    compare(spark, QUERIES[name], ORACLE_SQL[name])
