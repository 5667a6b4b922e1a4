"""Whole sessions: longer ones than the given, session folders, evaluation and exact sums."""

import json

import pytest
from pyspark.sql import functions as F
from session import TABLES, compare, duck

import __spark_entry__ as entry
from gapwise.bindings.views import Views
from gapwise.operators import odometry
from gapwise.operators.normalize import Limits
from gapwise.plans import evaluation
from gapwise.ordered import plan_axis
from gapwise.sources import tables

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def long_folder(spark, tmp_path_factory):
    """The events stretched over three months and repeated, so that sessions go beyond hour 720 and frame 100."""
    folder = str(tmp_path_factory.mktemp("long"))
    events = spark.read.parquet(f"{FOLDER}/events.parquet").filter("user_id < 4")
    first = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) * 3)
    later = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) * 3 + 7_000_000_000)
    kind = events.schema["ts"].dataType
    both = events.withColumn("ts", first.cast(kind)).unionByName(
        events.withColumns({"ts": later.cast(kind), "event_id": F.col("event_id") + 1_000_003})
    )
    both.coalesce(1).write.parquet(f"{folder}/all")
    import glob
    import shutil

    shutil.copy(glob.glob(f"{folder}/all/*.parquet")[0], f"{folder}/events.parquet")
    for name in TABLES:
        if name != "events":
            shutil.copy(f"{FOLDER}/{name}.parquet", f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", ["gate_visibility", "span_coverage", "segment_coverage", "check_case", "case_summary", "check_intervals"])
def test_extents_of_longer_sessions(spark, long_folder, name):
    rows, problem = compare(spark, duck(long_folder), entry.queries()[name], entry.oracle_sql()[name], long_folder)
    assert problem is None and rows > 0


def test_longer_sessions_are_looked_at_to_their_end(spark, long_folder):
    v = Views(spark, long_folder)
    last = v.sig.agg(F.max("time_s"), F.max("frame")).first()
    assert last[0] > 720 and last[1] > 100
    assert v.spans.agg(F.max("start_s")).first()[0] > 720
    assert v.segments.agg(F.max("frame_hi")).first()[0] > last[1] - 25


def test_sums_do_not_depend_on_chunks(spark, group_rows):
    """Distances and doubts to the last bit."""
    found = []
    for bound in (2_000_000, 9):
        group_rows(bound)
        v = Views(spark, FOLDER)
        rows = odometry.integrate(v.sig, v.axis, speed="value", quality="q", max_gap=24.0)
        found.append({(r.session_id, r.frame): (r.distance_m, r.odometry_uncertainty) for r in rows.collect()})
    assert found[0] == found[1]


def line(kind, frame, time_s, flags):
    own = {"schema_version": tables.SCHEMA_VERSION, "source_id": "s", "source_sha256": "d", "profile": "p", "frame": frame, "time_s": time_s,
           "source_time_s": 5.0 + time_s, "field_quality": flags, "field_reasons": {k: [] for k in flags}}
    if kind == "samples":
        sample = {"frame": frame, "time_s": time_s, "field_quality": flags, "field_reasons": own["field_reasons"], "speed_kmh": 12.5}
        return own | {"sample": sample}
    return own | {"observations": {k: {"value": 1.0, "quality": q, "raw_value": "1", "reasons": []} for k, q in flags.items()}}


def test_a_session_folder(spark, tmp_path):
    flags = {"speed_kmh": "observed"}
    manifest = {"schema_version": tables.SCHEMA_VERSION, "source_id": "s", "profile": "p", "frame_count": 3,
                "source": {"sha256": "d", "size_bytes": 1}, "clip_origin": {"start_s": 5.0}, "lap_transitions": []}
    (tmp_path / "manifest.json").write_text(json.dumps(manifest))
    for kind in ("samples", "observations"):
        lines = [line(kind, n, n / 10, flags) for n in range(3)]
        (tmp_path / f"{kind}.jsonl").write_text("\n".join(map(json.dumps, lines)))
    got = tables.read_session(spark, str(tmp_path))
    assert got["violations"].count() == 0
    assert [r.speed_kmh for r in got["samples"].orderBy("frame").collect()] == [12.5] * 3
    assert got["observations"].count() == 3
    lines = [line("observations", n, n / 10 + (n == 1), flags if n else {"speed_kmh": "held"}) for n in range(2)]
    lines[0]["field_quality"] = flags
    (tmp_path / "observations.jsonl").write_text("\n".join(map(json.dumps, lines)))
    rules = {(r.rule, r.key) for r in tables.read_session(spark, str(tmp_path))["violations"].collect()}
    assert rules == {("observation_quality", "0"), ("misaligned_rows", "1"), ("misaligned_rows", "2"), ("row_count", "rows")}


def test_legacy_records_need_limits(spark, tmp_path):
    path = tmp_path / "telemetry.csv"
    path.write_text("session_id,frame,time,speed,gear,quality_hint,new_column\ns,1,0.5,171,3,s:held,x\ns,2,0.6,,007,,y\n")
    with pytest.raises(ValueError):
        tables.read_session(spark, str(path))
    got = tables.read_session(spark, str(path), limits=Limits())
    assert {(r.schema_version, r.frame_count) for r in got["manifest"].collect()} == {("legacy", 2)}
    rows = sorted(got["samples"].collect(), key=lambda r: r.frame)
    assert (rows[0].speed_kmh, rows[0].field_quality["s"]) == (171.0, "held") and rows[1].speed_kmh is None


def test_indented_annotation_documents(spark, tmp_path):
    document = {"source_sha256": "d", "frames": [], "windows": [], "visibility": [], "lap_review": {"reviewed": True},
                "passages": [{"id": "a", "kind": "landmark", "landmark_id": "hairpin"}], "evaluation_segments": [{"frame_lo": 1, "frame_hi": 2}]}
    (tmp_path / "one.json").write_text(json.dumps(document, indent=2))
    parts = tables.read_annotations(spark, str(tmp_path / "one.json"))
    assert parts["passages"].first().landmark_id == "hairpin" and parts["evaluation_segments"].first().frame_hi == 2
    assert parts["lap_review"].first().reviewed is True and parts["frames"].count() == 0


def test_a_false_observation_fails_its_field(spark):
    labels = spark.createDataFrame(
        [("a", 1, "brake", 10.0, True), ("a", 2, "brake", None, False), ("b", 1, "brake", 10.0, True), ("c", 1, "brake", None, True)],
        "session_id string, frame long, field string, truth double, visible boolean",
    )
    samples = spark.createDataFrame(
        [("a", 1, "brake", 10.5, True), ("a", 2, "brake", 3.0, True), ("b", 1, "brake", 10.5, True), ("b", 2, "brake", 1.0, False)],
        "session_id string, frame long, field string, value double, fresh boolean",
    )
    found = evaluation.field_checks(labels, samples, ("session_id",), evaluation.EvaluationSettings(mae={"brake": 2.0}))
    status = {(r.session_id, r.part): (r.status, r["false"]) for r in found.collect()}
    assert status["a", "accuracy"] == ("fail", 1) and status["b", "accuracy"] == ("pass", 0)
    assert status["c", "accuracy"] == status["c", "coverage"] == ("not_evaluated", 0)
