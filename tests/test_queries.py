"""Registered queries against their SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from oracle_check import connect, difference

SF_DIR = "/root/testdata/sf0.001"

# Those that need no ingested feed; ``oracle_check.py`` runs all of them.
QUICK = [
    "json_document_batch", "collapsed_whitespace", "html_detection", "content_elements", "cleaned_pages", "decoded_entities",
    "folded_sources", "canonical_links", "epoch_dates", "iso_dates", "numeric_dates", "named_month_dates", "local_zone_dates",
    "mail_dates", "utc_days", "parsed_counts", "schemeless_links", "comparison_forms",
]

needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="tables are not here")


def test_every_query_has_sql():
    assert set(entry.registered.queries()) == set(entry.oracle_queries.oracle_sql())


@needs_tables
@pytest.mark.parametrize("name", QUICK)
def test_same_rows_as_sql(spark, name):
    assert difference(entry.queries()[name](spark, SF_DIR), connect(SF_DIR), entry.oracle_sql()[name]) == ""


@needs_tables
def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["group", "label", "count"] and rows.count() > 0
