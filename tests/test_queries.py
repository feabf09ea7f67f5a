"""Every registered query of the library against its SQL, on the smallest driver tables."""

import os

import pytest

from narae.plans import queries
from oracle import assert_same

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are absent")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, FOLDER), queries.SQL[name], FOLDER)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert queries.QUERIES[name](spark, FOLDER).limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 50
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
