"""Registered queries against their SQL at the smallest scale (check.py runs all of them at any scale)."""

import os

import pytest

import __spark_entry__ as entry
import check

SF = "/root/testdata/sf0.001"
CHOSEN = """graph_pairs edge_endpoints pair_connected negative_candidates typepair_connectivity band_flag compat_relation relation_pick node_degree
verification_scores decide_gate decision_reason decision_breakdown graph_hash graph_drift extra_time_references merge_extra_content nearest_rank_percentiles
recurring_problems half_trend cooccurring_concepts two_hop_chains recurring_chains coping_targets weekday_low_mood day_diff concept_streaks
stratified_split label_index negatives_random negatives_hard largest_remainder tv_distance multilabel_metrics roc_auc threshold_sweep parse_quality
banned_phrases_de markdown_clean frontmatter_split parse_date lexicon_match tfidf_vocabulary scan_samples scan_torn_tail extract_graphs
stream_usage_totals stream_day_diff udf_feature_fn udtf_pairs""".split()


def names():
    return list(entry.queries()) if os.environ.get("DAYGRAPH_ALL") else CHOSEN


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", names())
def test_query_equals_sql(spark, con, name):
    error, _ = check.compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert error == ""


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 28
