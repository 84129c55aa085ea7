import __spark_entry__
from lodestrand.plans import registry


def test_every_sql_belongs_to_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_flagship_query(spark):
    found = __spark_entry__.entry(spark)
    assert found.columns == ["id", "score"] and found.count() > 0
