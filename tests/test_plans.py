"""Plans of queries: what is computed once stays computed once."""

import pytest

from postmill.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["h4_seniority", "h6_salary", "h9_min_score"])
def test_a_filter_is_not_pushed_below_the_enrichment(spark, name):
    """Before, the condition held the enrichment once for every place that names one of its columns (h9: 593,149 characters)."""
    assert len(plan(catalog.QUERIES[name](spark, SF))) < 10_000


def test_only_wanted_columns_are_enriched(spark):
    assert catalog.enriched_table(spark, SF, "seq", "score").columns == ["seq", "score"]


@pytest.mark.parametrize("name", ["a13_cards_hn", "a21_cards_to_postings"])
def test_blobs_are_parsed_once(spark, name):
    """Before, a filter on the text stood below it with a copy of it: each task parsed all blobs twice, in two workers."""
    from postmill.plans import sources_catalog  # noqa: F401  registers them

    assert plan(catalog.QUERIES[name](spark, SF)).count("ArrowEvalPython") == 1
