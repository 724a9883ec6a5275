"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import subprocess
import sys

import pytest

import __spark_entry__ as entry
from compare import compare, duck
from conftest import ROOT, SF
from tillworks.sources import star_views

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# The smallest tables hold too few ratings for these supports.
MAY_BE_EMPTY = {"product_overall", "product_month_rankings"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    problems = compare(spark, con, SF, QUERIES[name], ORACLES[name])
    if name in MAY_BE_EMPTY:
        problems = [p for p in problems if p != "no rows"]
    assert problems == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 12


def test_skipped_dimension_joins_change_no_row(spark):
    """The shortcut of sales_lines rests on keys that always resolve."""
    every = [*star_views.LINE, *star_views.ORDER, *star_views.CUSTOMER, *star_views.PRODUCT]
    full = star_views.sales_lines(spark, SF, *every)
    assert full.count() == star_views.sales_lines(spark, SF, "order_id").count()


def test_results_do_not_depend_on_partitions(spark):
    name = "category_transactions_monthly"
    before = sorted(map(str, QUERIES[name](spark, SF).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert sorted(map(str, QUERIES[name](spark, SF).collect())) == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_models_run_without_the_package_on_the_executors(tmp_path):
    """Python workers start with another working directory on a cluster."""
    script = (
        "import sys; sys.path.insert(0, sys.argv[1])\n"
        "import __spark_entry__ as e\n"
        "from tillworks.session import local_session\n"
        "spark = local_session(2, 2)\n"
        "print(e.queries()['forecast_sales_by_series'](spark, sys.argv[2]).count() > 0)\n"
    )
    done = subprocess.run(
        [sys.executable, "-c", script, ROOT, SF], cwd=tmp_path, capture_output=True, text=True, timeout=300
    )
    assert done.stdout.strip().endswith("True"), done.stderr[-2000:]
