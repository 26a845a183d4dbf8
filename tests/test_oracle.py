"""Every registered query against its SQL twin, also with every group cut into chunks."""

import pytest
from oracle import compare
from samples_dir import SAMPLE

from reelgate.catalogue import ORACLES, QUERIES

CHUNKED = [
    "numbered_frames",
    "series_metrics",
    "level_range",
    "sliding_window_metrics",
    "balance",
    "dropout_fraction",
    "pitch_error",
    "level_match",
    "exact_quantiles",
    "robust_rank",
    "gap_fill",
    "spike_repair",
    "voiced_runs",
    "longest_run",
    "sustained_runs",
    "run_classes",
    "log_flux",
    "scaled_flux",
    "smooth_gain",
    "grid_interpolate",
    "phrase_coverage",
    "peak_pick",
    "stitch_gains",
    "tempo_correlations",
    "onset_stats",
    "interval_exclusion",
    "legal_transitions",
    "retry_order",
    "rank_references",
    "relative_level",
    "window_calibration",
    "non_overlapping_topk",
    "join_jumps",
]


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    assert compare(spark, duck, SAMPLE, name) is None


@pytest.mark.parametrize("name", CHUNKED)
def test_query_in_chunks(spark, duck, tiny_chunks, name):
    assert compare(spark, duck, SAMPLE, name) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
