"""Every query that has SQL gives what DuckDB gives for it, over the whole smallest tables."""

import os

import pytest

from tests.harness import DATA, compare, connect
from wakegraph.queries import all_queries, all_sql

BASE = f"{DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return connect(BASE)


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_agrees_with_sql(spark, con, name):
    ok, what = compare(spark, con, name, all_queries()[name], all_sql()[name], BASE)
    assert ok, what


def test_every_query_is_named_once():
    assert set(all_sql()) <= set(all_queries())


def test_flagship(spark):
    import __spark_entry__

    assert set(__spark_entry__.entry(spark).columns) == {"fqn", "risk", "entry_count", "n_entries", "urls", "n_tasks"}
