"""Every observation query with SQL against DuckDB over the same files."""

import os

import compare
import pytest

from gridobs.plans import queries as q

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# too few rows at this scale for a rule that needs more of them
MAY_BE_EMPTY = {"compare_years", "valid_cells", "monthly_climatology", "yearly_deviation", "anomaly_strict", "monthly_cube", "anomaly_cross_sensor"}


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_same_rows_as_sql(spark, con, name):
    n, m, wrong, n_wrong = compare.differences(q.QUERIES[name](spark, SF), con, q.SQL[name])
    assert (n, n_wrong) == (m, 0), wrong
    assert n or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.SQL)))
def test_queries_without_sql_run(spark, name):
    assert q.QUERIES[name](spark, SF).count()
