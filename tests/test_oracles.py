"""Every query of the engine against DuckDB on the smallest tables."""

import pytest
from conftest import SMALL, same_rows

from tidemark.plans import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = same_rows(queries.QUERIES[name](spark, SMALL), duck, queries.ORACLES[name])
    assert ours == theirs


def test_entry(spark):
    import __spark_entry__ as entry

    found = entry.entry(spark)
    assert found.count() > 0 and {r.f_type for r in found.collect()} <= {"enter", "exit"}
    assert set(entry.oracle_sql()) <= set(entry.queries())
