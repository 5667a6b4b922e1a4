"""Canonical schemas and closed domains."""

# Quality flags, progress sources and span states.
QUALITY = ("observed", "missing", "held", "interpolated", "predicted", "fused", "anomalous")
PROGRESS_SOURCES = ("observed", "fused", "predicted", "interpolated", "missing")
SPAN_STATES = ("visible", "absent", "unknown")

# Schemas are DDL text, which needs no running session.
SAMPLE = (
    "frame bigint, time_s double, lap_number int, lap_time_s double, s double, "
    "speed_kmh double, gear int, throttle_pct double, brake_pct double, steering double, "
    "tc_active boolean, abs_active boolean, field_quality map<string,string>, "
    "field_reasons map<string,array<string>>, anomalies array<string>, s_odometry double, "
    "s_visual double, s_uncertainty double, s_source string, s_reasons array<string>"
)

OBSERVATION = (
    "value double, quality string, raw_value string, reasons array<string>, "
    "last_observed_time_s double"
)

_ENVELOPE = "schema_version string, source_id string, source_sha256 string, profile string, "
_ROW = "frame bigint, time_s double, source_time_s double, "
_FLAGS = "field_quality map<string,string>, field_reasons map<string,array<string>>"

SAMPLE_LINE = f"{_ENVELOPE}{_ROW}{_FLAGS}, sample struct<{SAMPLE}>"
OBSERVATION_LINE = f"{_ENVELOPE}{_ROW}{_FLAGS}, observations map<string,struct<{OBSERVATION}>>"

MANIFEST = (
    "schema_version string, source_id string, profile string, frame_count bigint, "
    "source struct<sha256:string,size_bytes:bigint>, clip_origin struct<start_s:double>, "
    "lap_transitions array<struct<frame:bigint,time_s:double,from_lap:int,to_lap:int,"
    "confidence:double,first_candidate_time_s:double,confirmed_at_s:double,"
    "last_previous_lap_observed_time_s:double>>"
)

ANNOTATIONS = (
    "schema_version string, source_sha256 string, role string, recording_id string, "
    "annotator string, reviewed boolean, "
    "frames array<struct<frame:bigint,time_s:double,speed_text:string,gear_text:string,"
    "lap_text:string,throttle_pct:double,brake_pct:double,pedal_tolerance_pct:double,"
    "visibility:map<string,boolean>,degraded:boolean,reviewed:boolean>>, "
    "passages array<struct<id:string,kind:string,event_type:string,field:string,"
    "frame_lo:bigint,frame_hi:bigint,reviewed:boolean,landmark_id:string,event_window_id:string,"
    "eligible_for_5pct_crossing_latency:boolean,exclusion_reason:string,"
    "threshold_crossing_reviewed:boolean,threshold_pct:double,physical_landmark_reviewed:boolean,"
    "reference:string,definition:string>>, "
    "windows array<struct<frame_lo:bigint,frame_hi:bigint>>, "
    "visibility array<struct<field:string,start_s:double,end_s:double,reviewer:string>>, "
    "evaluation_segments array<struct<frame_lo:bigint,frame_hi:bigint>>, "
    "lap_review struct<reviewed:boolean,complete_real_and_suspect_transitions:boolean,"
    "frame_lo:bigint,frame_hi:bigint>"
)

# Columns of the flat record that stay literal text.
LITERAL_COLUMNS = (
    "speed_raw", "gear_raw", "quality_hint", "field_reasons", "s_reasons", "s_source",
)
LEGACY_COLUMNS = (
    "frame", "time", "lap_number", "lap_time", "track_position", "speed", "gear",
    "throttle", "brake", "steering", "tc_active", "abs_active",
)
MODERN_COLUMNS = (
    "raw_lap_number", "speed_raw", "gear_raw", "quality_hint", "field_reasons", "s_odometry",
    "s_visual", "s_fused", "s_uncertainty", "s_source", "s_reasons",
)
