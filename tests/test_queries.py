"""Every query that SQL can express equals its SQL."""

import sys

import pytest

sys.path.insert(0, __file__.rpartition("/")[0])
from oracle import check, connect

from stratigraph.plans.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    check(QUERIES[name](spark, DIR), con, SQL[name])


@pytest.mark.parametrize("name", ["pca_cosine_invariant", "resolution_profile", "merge_cascade", "shuffled_sequences", "hdbscan_baseline", "density_tables"])
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_shuffled_letters_stay(spark):
    assert QUERIES["shuffled_sequences"](spark, DIR).where("not same_letters").count() == 0


def test_entry_gives_one_row(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
