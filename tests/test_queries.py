"""Every registered query against its checking SQL."""

import pytest

import __spark_entry__ as entry_points
from compare import compare
from scoreloom.plans.catalog import CHECKS, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    if name in CHECKS:
        assert compare(df, duck, CHECKS[name]) is None
    else:
        assert df.collect()


def test_every_check_belongs_to_a_query():
    assert set(CHECKS) <= set(QUERIES)
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry(spark, sf_dir):
    assert entry_points.entry(spark).count() == 7
