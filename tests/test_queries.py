"""Every registered query against its SQL on the smallest tables."""

import pytest
from conftest import SF
from oracle_check import compare

import __spark_entry__ as entry
from spendtide.plans.catalog import QUERIES

# Fitted numbers: SQL cannot state them. Checked in test_models.py; what does not depend on them
# has queries with SQL of its own.
ROWS_ONLY = {"trend_forecast", "isolation_scores", "signal_summary_models"}


def test_only_models_lack_sql():
    assert set(QUERIES) - set(entry.oracle_sql()) == ROWS_ONLY
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    assert compare(spark, name, SF) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns[:4] == ["brand", "week_key", "channel", "region"]
