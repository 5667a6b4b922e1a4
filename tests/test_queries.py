"""Registered queries against their SQL, and whole keys against small chunks."""

import pytest
from session import compare, normal

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
CHECKED = (
    "evidence_runs", "evidence_gaps", "missing_intervals", "hysteresis_events", "control_episodes",
    "overlap_intervals", "resumptions", "normalize_records", "classify_speed_text", "bounded_laps",
    "gate_visibility", "confirm_labels", "admit_rate", "integrate", "lap_distances",
    "calibrate_length", "rolling_majority", "median_with_recovery", "validate_position",
    "field_errors", "session_summary", "circular_range", "gate_report", "consistency_counters",
    "checkpoint_spread", "unique_event_in_window", "resample_on_grid", "time_delta",
    "project_points", "path_position", "select_projection", "fuse_progress", "nearest_gated",
    "check_intervals", "check_partition", "check_case", "read_samples_jsonl", "stream_events",
    "evaluate_session", "evaluate_session_checks", "progress_diagnosis", "read_legacy_records",
    "check_observation_lines", "read_annotation_values", "compare_chosen_laps", "lap_report_events",
)
CHUNKED = (
    "control_episodes", "confirm_labels", "integrate", "resample_on_grid", "fuse_progress",
    "match_metrics", "gate_visibility", "rolling_majority", "path_position",
)


def test_every_operator_is_registered():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert len(queries) > 100
    assert set(oracles) <= set(queries)


@pytest.mark.parametrize("name", CHECKED)
def test_equals_sql(spark, con, name):
    rows, problem = compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], FOLDER)
    assert problem is None
    assert rows > 0


@pytest.mark.parametrize("name", CHUNKED)
def test_chunks_change_nothing(spark, group_rows, name):
    results = []
    for bound in (2_000_000, 9):
        group_rows(bound)
        df = entry.queries()[name](spark, FOLDER)
        results.append(normal(df.columns, [tuple(r) for r in df.collect()]))
    assert results[0] == results[1]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
