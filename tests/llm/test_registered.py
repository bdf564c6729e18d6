"""Registered queries of the package against their SQL on the smallest tables."""

import pytest
from conftest import SF
from oracle_check import compare

from spendtide.llm import queries


def test_names():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 14))
    assert set(queries.QUERIES) - set(queries.oracle_sql()) == {"op2_best_fit_packing", "op10_source_mixing", "pipeline"}


def test_scores_decide_pages_of_linked_hosts(spark):
    """The propagated scores block pages that no rule names, and leave others alone."""
    got = queries.QUERIES["linked_url_filters"](spark, SF).filter("rule is null").groupBy("verdict").count().collect()
    assert {r.verdict for r in got} == {"allow", "block"}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    assert compare(spark, name, SF) is None
