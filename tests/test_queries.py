import pytest

from glyphflow.plans import queries
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, tiny, name):
    compare(spark, tiny, queries.QUERIES[name], queries.SQL[name])


def test_entry(spark):
    import __spark_entry__

    entry = __spark_entry__.entry(spark)
    assert entry.columns == ["roi", "seq", "start", "line"] and entry.count() > 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
