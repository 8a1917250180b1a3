"""Every registered query against its check SQL on the smallest data set."""

import pytest

from tallymark.registry import oracle_sql, queries
from tests.compare import check_connection, compare

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check_connection(FOLDER)


# the smallest data set holds no resource with three given skills and no orphaned match for these
MAY_BE_EMPTY = {"skill_match", "q_over_allocated", "q_date_order"}


@pytest.mark.parametrize("key", sorted(queries()))
def test_query_equals_check_sql(spark, con, key):
    problem = compare(spark, FOLDER, key, con)
    assert problem is None or (problem == "no rows" and key in MAY_BE_EMPTY)


def test_every_query_has_check_sql():
    assert set(queries()) == set(oracle_sql())


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
