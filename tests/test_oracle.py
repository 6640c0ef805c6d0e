"""Every query of the library against its SQL, and those without SQL for rows."""

import os

import helpers
import pytest

from coursewatch.queries import ORACLE, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    assert helpers.differences(QUERIES[name](spark, SF), ORACLE[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["course_id", "type", "n"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
