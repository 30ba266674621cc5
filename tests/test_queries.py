"""Every registered query against its SQL on the smallest tables."""

import pytest

from compare import compare, make_duck
from sharelens.plans.catalog import QUERIES, SQL

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return make_duck(SF_DIR)


# the month matrix and the top-125 table need more rows than this scale has in every cell
MAY_BE_EMPTY = {"host_totals_floor"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    problem, rows, _, _ = compare(spark, duck, QUERIES[name], SQL.get(name), SF_DIR)
    if name in MAY_BE_EMPTY and problem == "no rows":
        return
    assert not problem


def test_only_non_sql_queries_lack_sql():
    assert set(QUERIES) - set(SQL) == {"cluster_hosts", "cluster_hosts_kmeans"}


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["dim", "side", "rank", "id", "score"] and df.count() == 40
