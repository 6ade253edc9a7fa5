"""Registered queries against DuckDB on whole (small) tables."""

import pytest

import __spark_entry__ as entry
from diffloom.catalog import REGISTRY as CATALOG
from compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n, (_, sql) in CATALOG.items() if sql])
def test_query_matches_sql(spark, con, name):
    problem, _ = compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])
    assert problem is None


@pytest.mark.parametrize("name", [n for n, (_, sql) in CATALOG.items() if not sql])
def test_query_without_sql_has_rows(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["lang", "bleu"]


@pytest.mark.parametrize("name", ["edit_script_profile", "sharded_corpus", "line_churn"])
def test_partitions_do_not_matter(spark, name):
    def run(n):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        return sorted(map(str, entry.queries()[name](spark, SF).collect()))

    try:
        assert run(3) == run(8)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
