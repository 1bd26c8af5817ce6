"""Every registered query against its oracle SQL, on the smallest scale."""

import pytest

from plumbline.queries import catalog
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_matches_oracle(spark, con, name):
    problem = compare(catalog.QUERIES[name](spark, SF), con, catalog.ORACLE[name])
    assert problem is None, problem


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs_without_oracle(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["dataset", "column_name", "issue_type", "severity", "n_bad", "n_checked", "pct"]
    assert set(e.oracle_sql()) <= set(e.queries())
