import __spark_entry__ as entry
from spanloom.plans import queries
from spanloom.plans.records import COLUMNS


def test_flagship_and_names(spark):
    assert tuple(entry.entry(spark).columns) == COLUMNS
    assert set(queries.SQL) <= set(queries.QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())
