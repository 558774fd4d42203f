"""A cross-section of the bound queries against their SQL; check.py runs all of them."""

import pytest

import __spark_entry__ as entry
from check import compare, connect
from evimap.plans import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
NAMES = (
    "flatten_leaves", "complexity_limits", "sibling_context", "sanitize_json", "clean_text", "render_query", "trusted_url", "search_url",
    "epoch_to_ts", "parse_iso_ts", "eligible_timestamp", "reject_reasons", "coverage", "value_windows", "validate_scores", "statuses",
    "topk_resolutions", "historic_lines", "readiness", "resolve_aliases", "event_table_documents", "dedupe_documents", "extract_result_rows",
    "merge_views", "mapping_metrics", "promotion_gate", "negative_sampling", "length_buckets", "derive_decisions", "validate_records",
    "verify_hashes", "scan_ip", "scan_email_tenant", "compile_items", "dataset_manifest", "stream_distinct_tickets", "settled_snapshot",
    "settled_pages", "model_scores", "mapper_hook", "enrich", "apply_mapping",
)


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, con, name):
    problem, _ = compare(spark, con, FOLDER, name, entry.queries()[name], entry.oracle_sql()[name])
    assert problem == ""


def test_every_query_of_the_plans_has_sql():
    assert set(QUERIES) == set(ORACLES) <= set(entry.oracle_sql())
