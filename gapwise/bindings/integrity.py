"""Queries on checks, sources, sinks, composite jobs and streams."""

import uuid

from pyspark.sql import functions as F

from gapwise.bindings.alignment import FUSION, fuse_input
from gapwise.bindings.distance import WALK
from gapwise.bindings.normalization import raw_records
from gapwise.bindings.registry import ORACLES, register
from gapwise.bindings.runs import (
    CROSSINGS_CTE,
    BRAKE_OK, EPISODES, EPISODE_DOUBLES, OVERLAPS_CTE, THROTTLE_OK,
    episodes_sql, events_sql,
)
from gapwise.bindings.selections import BOUNDED, bounded
from gapwise.bindings.summaries import (
    MATCHING, METRICS_CTE,
    PASSAGES_CTE, POINTS, UNIQUE_CTE, passages, truth_points,
)
from gapwise.bindings.views import (
    BOUNDARIES, BRAKE, CROSSING, FRAME_TIME, GEAR, LABEL_COUNT, MATCH_WINDOW, MAX_RATE, MAX_RATE_GAP, OBS,
    SETTINGS, SIG, SPANS_CTE, THROTTLE, ZONES_CTE, Views,
)
from gapwise.operators import checks, episodes, labels, runs
from gapwise.ordered import Axis, materialize, shared_folder
from gapwise.plans import jobs
from gapwise.sources import tables
from gapwise.streaming import causal

KEY = ("session_id",)


def scratch(v: Views, name: str) -> str:
    """A new folder beside the checkpoints, which all executors can reach."""
    return f"{shared_folder(v.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# --- checks ---------------------------------------------------------------------------


@register(
    "check_intervals",
    SIG + SPANS_CTE + """, s AS (
  SELECT session_id, field, start_s, CASE WHEN (session_id + start_s) % 7 = 0 THEN end_s + 24
           WHEN (session_id + start_s) % 11 = 0 THEN start_s ELSE end_s END AS end_s,
         CASE WHEN (session_id + start_s) % 13 = 0 THEN ' ' ELSE 'r' END AS reviewer,
         CASE WHEN (session_id + start_s) % 17 = 0 THEN 'odd' ELSE state END AS state
  FROM spans
), p AS (
  SELECT *, lag(end_s) OVER (PARTITION BY session_id, field ORDER BY start_s, end_s) AS pe FROM s
), r AS (
  SELECT session_id, 'not_ordered' AS rule, start_s FROM p WHERE NOT (start_s >= 0 AND start_s < end_s)
  UNION ALL SELECT session_id, 'overlap', start_s FROM p WHERE start_s < pe
  UNION ALL SELECT session_id, 'after_end', start_s FROM p JOIN (SELECT session_id, max(time_s) AS m FROM sig GROUP BY ALL)
    USING (session_id) WHERE end_s > m
  UNION ALL SELECT session_id, 'blank_reviewer', start_s FROM p WHERE trim(reviewer) = ''
  UNION ALL SELECT session_id, 'unknown_state', start_s FROM p WHERE state = 'odd'
)
--
SELECT session_id, rule, 'brake@' || start_s::DOUBLE AS key FROM r""",
)
def check_intervals(v: Views):
    x = (F.col("session_id") + F.col("start_s")).cast("long")
    spans = v.spans.withColumns(
        {
            "end_s": F.when(x % 7 == 0, F.col("end_s") + 24)
            .when(x % 11 == 0, F.col("start_s"))
            .otherwise(F.col("end_s")),
            "reviewer": F.when(x % 13 == 0, " ").otherwise("r"),
            "state": F.when(x % 17 == 0, "odd").otherwise(F.col("state")),
        }
    )
    durations = v.sig.groupBy("session_id").agg(F.max("time_s").alias("duration_s"))
    return checks.check_intervals(spans, KEY, durations)


@register(
    "check_windows",
    SIG + """, w AS (
  SELECT session_id, frame AS frame_lo, frame + event_id % 5 - 1 AS frame_hi FROM sig
  WHERE event_id % 3 = 0
), p AS (
  SELECT w.*, lag(frame_hi) OVER (PARTITION BY session_id ORDER BY frame_lo, frame_hi) AS ph, n
  FROM w JOIN (SELECT session_id, max(frame) AS n FROM sig GROUP BY session_id) USING (session_id)
)
--
SELECT session_id, 'outside_recording' AS rule, CAST(frame_lo AS VARCHAR) AS key FROM p
WHERE NOT (frame_lo <= frame_hi AND frame_hi < n)
UNION ALL SELECT session_id, 'overlap', CAST(frame_lo AS VARCHAR) FROM p WHERE frame_lo <= ph""",
)
def check_windows(v: Views):
    e, f = F.col("event_id"), F.col("frame")
    windows = v.sig.filter(e % 3 == 0).select(
        "session_id", f.alias("frame_lo"), (f + e % 5 - 1).alias("frame_hi")
    )
    counts = v.sig.groupBy("session_id").agg(F.max("frame").alias("frame_count"))
    return checks.check_windows(windows, v.axis, counts)


@register(
    "check_partition",
    SIG + ZONES_CTE + """, z AS (
  SELECT session_id, CASE WHEN (session_id + start_frame // 10) % 9 = 0 THEN 'bad id' ELSE id END AS id,
         start_frame + CASE WHEN (session_id + start_frame // 10) % 8 = 0 THEN 1 ELSE 0 END AS start_frame,
         end_frame, m FROM zones JOIN (SELECT session_id, max(frame) AS m FROM sig GROUP BY ALL)
         USING (session_id)
), p AS (
  SELECT *, lag(end_frame) OVER w AS pe, lead(id) OVER w AS n,
         count(*) OVER (PARTITION BY session_id, id) AS uses
  FROM z WINDOW w AS (PARTITION BY session_id ORDER BY start_frame, end_frame)
)
--
SELECT session_id, 'invalid_id' AS rule, id AS key FROM p WHERE id = 'bad id'
UNION ALL SELECT session_id, 'repeated_id', id FROM p WHERE uses > 1
UNION ALL SELECT session_id, 'hole_or_overlap', id FROM p WHERE pe <> start_frame
UNION ALL SELECT session_id, 'wrong_start', id FROM p WHERE pe IS NULL AND start_frame <> 0
UNION ALL SELECT session_id, 'wrong_end', id FROM p WHERE n IS NULL AND end_frame <> m + 1""",
)
def check_partition(v: Views):
    i = F.floor(F.col("start_frame") / 10)
    x = F.col("session_id") + i
    zones = v.zones.withColumns(
        {
            "id": F.when(x % 9 == 0, "bad id").otherwise(F.col("id")),
            "start_frame": F.col("start_frame") + F.when(x % 8 == 0, 1).otherwise(0),
        }
    )
    bounds = v.sig.groupBy("session_id").agg(
        F.lit(0).alias("lo"), (F.max("frame") + 1).alias("hi")
    )
    return checks.check_partition(zones, v.axis, bounds)


@register(
    "check_clock",
    SIG + """, p AS (
  SELECT *, lag(frame) OVER w AS pf, lag(time_s) OVER w AS pt
  FROM (SELECT session_id, CASE WHEN event_id % 30 = 0 THEN frame - 2 ELSE frame END AS frame,
               time_s, frame AS o FROM sig)
  WINDOW w AS (PARTITION BY session_id ORDER BY o)
)
--
SELECT session_id, 'invalid_frame' AS rule, CAST(frame AS VARCHAR) AS key FROM p WHERE frame < 0
UNION ALL SELECT session_id, 'frame_not_increasing', CAST(frame AS VARCHAR) FROM p WHERE frame <= pf
UNION ALL SELECT session_id, 'time_not_increasing', CAST(frame AS VARCHAR) FROM p WHERE time_s <= pt
UNION ALL SELECT session_id, 'cadence', CAST(frame AS VARCHAR) FROM p
WHERE abs((time_s - pt) - (frame - pf)) > greatest(1e-8,
      1e-9 * greatest(abs(time_s - pt), abs(frame - pf)))""",
)
def check_clock(v: Views):
    moved = F.when(F.col("event_id") % 30 == 0, F.col("frame") - 2).otherwise(F.col("frame"))
    rows = v.sig.select("session_id", F.col("frame").alias("o"), moved.alias("frame"), "time_s")
    return checks.check_clock(rows, Axis(KEY, ("o",), v.axis.width), FRAME_TIME)


@register(
    "check_lap_clock",
    BOUNDED + """, j AS (
  SELECT b.session_id, b.lap_number, any_value(b.end_frame - b.start_frame) AS want, count(l.frame) AS n,
         count(*) FILTER (WHERE abs(l.time_s - b.start_time_s - (l.frame - b.start_frame)) > 1e-8) AS off
  FROM bounded b LEFT JOIN laps l ON l.session_id = b.session_id
   AND l.frame >= b.start_frame AND l.frame < b.end_frame GROUP BY ALL
)
--
SELECT session_id, 'incomplete' AS rule, CAST(lap_number AS VARCHAR) AS key FROM j WHERE n <> want
UNION ALL SELECT session_id, 'misaligned', CAST(lap_number AS VARCHAR) FROM j WHERE off > 0""",
)
def check_lap_clock(v: Views):
    return checks.check_lap_clock(v.sig, bounded(v), v.axis, FRAME_TIME)


@register(
    "audit_timebase",
    """WITH e AS (
  SELECT user_id, epoch_us(ts) / 3.6e9 AS t, ts, event_id FROM events WHERE event_id % 10 <> 3
), p AS (
  SELECT user_id, t, t - lag(t) OVER w AS step, row_number() OVER w - 1 AS i, first_value(t) OVER w AS t0
  FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), a AS (
  SELECT user_id, count(*) AS frame_count, bool_and(coalesce(step > 0, TRUE)) AS monotonic,
         max(abs(t - t0 - i * 10.5)) AS max_residual, max(abs(step - 10.5)) AS max_step_error
  FROM p GROUP BY user_id
)
--
SELECT *, CASE WHEN frame_count >= 2 AND monotonic AND max_residual <= 40 THEN 'pass' ELSE 'fail' END
         AS status FROM a""",
    "max_residual max_step_error",
)
def audit_timebase(v: Views):
    rows = v.events.select(
        "user_id", "event_id", "us", (F.col("us") / 3.6e9).alias("t"),
        F.when(F.col("event_id") % 10 == 3, "KD").otherwise("K_").alias("flags"),
    )
    found = checks.audit_timebase(
        rows, v._event_axis, "t", rate=1 / 10.5, tick=40.0, flags="flags"
    )
    return found.select("user_id", "frame_count", "monotonic", "max_residual", "max_step_error",
                        "status")


@register(
    "audit_timebase_strict",
    """WITH e AS (
  SELECT user_id, epoch_us(ts) / 3.6e9 AS t, ts, event_id FROM events
), p AS (
  SELECT user_id, t, t - lag(t) OVER w AS step, row_number() OVER w - 1 AS i, first_value(t) OVER w AS t0
  FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
)
--
SELECT user_id, CASE WHEN count(*) >= 2 AND bool_and(coalesce(step > 0, TRUE))
       AND max(abs(step - 50)) <= 45 + 1e-6 AND max(abs(t - t0 - i * 50)) <= 50 THEN 'pass' ELSE 'fail' END
       AS status FROM p GROUP BY user_id""",
)
def audit_timebase_strict(v: Views):
    rows = v.events.withColumn("t", F.col("us") / 3.6e9)
    found = checks.audit_timebase(rows, v._event_axis, "t", rate=1 / 50.0, tick=45.0, strict=True)
    return found.select("user_id", "status")


def sample_lines(v: Views):
    """The signal as sample lines: the envelope repeats time, flags and reasons."""
    q = F.create_map(F.lit("brake_pct"), F.col("q"), F.lit("throttle_pct"), F.lit("observed"))
    why = F.create_map(F.lit("brake_pct"), F.array(F.col("event_type")))
    source = F.col("session_id").cast("string")
    null = F.lit(None)
    sample = F.struct(
        F.col("frame"), F.col("time_s"), F.col("lap_number"), null.cast("double").alias("lap_time_s"),
        F.col("s"), F.col("value").alias("speed_kmh"), F.col("gear"), F.col("k").alias("throttle_pct"),
        F.col("v").alias("brake_pct"), ((F.col("k") - 50) / 50).alias("steering"),
        null.cast("boolean").alias("tc_active"), null.cast("boolean").alias("abs_active"),
        q.alias("field_quality"), why.alias("field_reasons"),
        F.array().cast("array<string>").alias("anomalies"), null.cast("double").alias("s_odometry"),
        null.cast("double").alias("s_visual"), null.cast("double").alias("s_uncertainty"),
        F.lit("observed").alias("s_source"), F.array().cast("array<string>").alias("s_reasons"),
    )
    return v.sig.select(
        F.lit(tables.SCHEMA_VERSION).alias("schema_version"), source.alias("source_id"),
        F.sha2(source, 256).alias("source_sha256"), F.lit("profile").alias("profile"), "frame",
        "time_s", (F.col("time_s") + 5.0).alias("source_time_s"), q.alias("field_quality"),
        why.alias("field_reasons"), sample.alias("sample"), "event_id",
    )


@register(
    "check_envelope",
    SIG + """
--
SELECT CAST(session_id AS VARCHAR) AS source_id, 'time' AS rule, CAST(frame AS VARCHAR) AS key FROM sig
WHERE event_id % 21 = 0
UNION ALL SELECT CAST(session_id AS VARCHAR), 'source_time', CAST(frame AS VARCHAR) FROM sig
WHERE event_id % 21 = 0
UNION ALL SELECT CAST(session_id AS VARCHAR), 'quality', CAST(frame AS VARCHAR) FROM sig
WHERE event_id % 23 = 0
UNION ALL SELECT CAST(session_id AS VARCHAR), 'reasons', CAST(frame AS VARCHAR) FROM sig
WHERE event_id % 27 = 0
UNION ALL SELECT CAST(session_id AS VARCHAR), 'foreign_envelope', CAST(frame AS VARCHAR) FROM sig
WHERE event_id % 33 = 0""",
)
def check_envelope(v: Views):
    e = F.col("event_id")
    none = F.create_map().cast("map<string,array<string>>")
    lines = sample_lines(v).withColumns(
        {
            "time_s": F.when(e % 21 == 0, F.col("time_s") + 1).otherwise(F.col("time_s")),
            "field_quality": F.when(e % 23 == 0, F.create_map(F.lit("brake_pct"), F.lit("fused")))
            .otherwise(F.col("field_quality")),
            "field_reasons": F.when(e % 27 == 0, none).otherwise(F.col("field_reasons")),
            "profile": F.when(e % 33 == 0, "other").otherwise(F.col("profile")),
        }
    )
    source = F.col("session_id").cast("string")
    manifest = v.sessions.select(
        source.alias("source_id"), F.lit(tables.SCHEMA_VERSION).alias("schema_version"),
        F.sha2(source, 256).alias("source_sha256"), F.lit("profile").alias("profile"),
        F.lit(5.0).alias("start_s"),
    )
    # The identity is compared as a whole, so the key is read from a copy.
    lines = lines.withColumn("src", F.col("source_id"))
    manifest = manifest.withColumn("src", F.col("source_id"))
    found = checks.check_envelope(lines, ("src",), manifest)
    return found.withColumnRenamed("src", "source_id")


@register(
    "check_hashes",
    """
--
SELECT CAST(doc_id AS VARCHAR) AS key, 'integrity_mismatch' AS rule FROM documents
WHERE doc_id % 10 = 0 AND doc_id % 17 <> 0
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'not_recorded' FROM documents WHERE doc_id % 17 = 0""",
)
def check_hashes(v: Views):
    files = v.table("documents").select("doc_id", "text")
    digest = F.sha2(F.col("text").cast("binary"), 256)
    recorded = F.when(F.col("doc_id") % 10 == 0, F.sha2(F.lit("changed"), 256)).otherwise(digest)
    manifest = files.select("doc_id", recorded.alias("sha256")).filter(F.col("doc_id") % 17 != 0)
    return checks.check_hashes(files, manifest, "doc_id", "text")


def annotation_frames(v: Views):
    e = F.col("event_id")
    seen = F.create_map(
        *[x for f in checks.VISIBILITY_FIELDS for x in (
            F.lit(f), F.when((F.lit(f) == "brake") & (e % 9 == 0), F.lit(False)).otherwise(True))]
    )
    return v.sig.filter(F.col("event_type").isin("purchase", "click")).select(
        "session_id", "event_id", "frame",
        F.when(e % 14 == 0, F.col("time_s") + 1).otherwise(F.col("time_s")).alias("time_s"),
        F.when(e % 12 == 0, "8?").when(e % 5 == 0, F.lit(None)).otherwise(
            F.floor("value").cast("string")).alias("speed_text"),
        F.when(e % 16 == 0, "8").otherwise("3").alias("gear_text"),
        F.when(e % 18 == 0, "L1").otherwise("12").alias("lap_text"),
        F.col("k").alias("throttle_pct"),
        F.when(e % 22 == 0, F.lit(130.0)).otherwise(F.col("v")).alias("brake_pct"),
        F.when(e % 26 != 0, F.lit(2.0)).alias("pedal_tolerance_pct"),
        seen.alias("visibility"), (e % 4 == 0).alias("degraded"),
        (e % 28 != 0).alias("reviewed"),
    )


ANNOTATED = SIG + """, a AS (
  SELECT session_id, event_id, frame, v, k, value FROM sig WHERE event_type IN ('purchase', 'click')
)"""


@register(
    "check_annotation_frames",
    ANNOTATED + """, r AS (
  SELECT session_id, frame, 'unreviewed' AS rule FROM a WHERE event_id % 28 = 0
  UNION ALL SELECT session_id, frame, 'time_mismatch' FROM a WHERE event_id % 14 = 0
  UNION ALL SELECT session_id, frame, 'speed_text_literal' FROM a WHERE event_id % 12 = 0
  UNION ALL SELECT session_id, frame, 'gear_text_domain' FROM a WHERE event_id % 16 = 0
  UNION ALL SELECT session_id, frame, 'lap_text_literal' FROM a WHERE event_id % 18 = 0
  UNION ALL SELECT session_id, frame, 'brake_range' FROM a WHERE event_id % 22 = 0
  UNION ALL SELECT session_id, frame, 'brake_not_visible' FROM a
            WHERE event_id % 9 = 0 AND (v IS NOT NULL OR event_id % 22 = 0)
  UNION ALL SELECT session_id, frame, 'brake_tolerance' FROM a
            WHERE event_id % 26 = 0 AND (v IS NOT NULL OR event_id % 22 = 0)
  UNION ALL SELECT session_id, frame, 'throttle_tolerance' FROM a WHERE event_id % 26 = 0
)
--
SELECT session_id, rule, CAST(frame AS VARCHAR) AS key FROM r""",
)
def check_annotation_frames(v: Views):
    capture = v.sig.select("session_id", "frame", F.col("time_s").alias("capture_time_s"))
    return checks.check_annotation_frames(annotation_frames(v), capture, KEY)


def reviewed_passages(v: Views):
    e = F.col("event_id")
    kind = F.when(e % 6 == 5, "lap_boundary").when(e % 17 == 0, "odd").otherwise("pedal_event")
    return v.sig.filter(F.col("event_type") == "purchase").select(
        "session_id", "event_id", F.concat(F.lit("p"), F.floor(e / 2)).alias("id"),
        kind.alias("kind"), F.when(e % 4 != 1, "brake").alias("field"),
        (F.col("frame") - 1).alias("frame_lo"), F.col("frame").alias("frame_hi"),
        (e % 20 != 0).alias("reviewed"), (e % 5 != 0).alias("physical_landmark_reviewed"),
        F.concat(F.lit("w"), F.floor(e / 50)).alias("event_window_id"),
    )


PASSAGES_REVIEWED = SIG + """, p AS (
  SELECT session_id, event_id, 'p' || event_id // 2 AS id,
         CASE WHEN event_id % 6 = 5 THEN 'lap_boundary' WHEN event_id % 17 = 0 THEN 'odd'
              ELSE 'pedal_event' END AS kind,
         frame - 1 AS frame_lo, frame AS frame_hi, event_id % 5 <> 0 AS physical,
         'w' || event_id // 50 AS win
  FROM sig WHERE event_type = 'purchase'
)"""


@register(
    "check_passages",
    PASSAGES_REVIEWED + """, q AS (
  SELECT *, count(*) OVER (PARTITION BY session_id, id) AS uses, n
  FROM p JOIN (SELECT session_id, max(frame) AS n FROM sig GROUP BY ALL) USING (session_id)
)
--
SELECT session_id, 'outside_recording' AS rule, id AS key FROM q WHERE frame_lo < 0 OR frame_hi >= n
UNION ALL SELECT session_id, 'unreviewed', id FROM q WHERE event_id % 20 = 0
UNION ALL SELECT session_id, 'repeated_id', id FROM q WHERE uses > 1
UNION ALL SELECT session_id, 'unknown_kind', id FROM q WHERE kind = 'odd'
UNION ALL SELECT session_id, 'pedal_without_field', id FROM q
WHERE kind = 'pedal_event' AND event_id % 4 = 1""",
)
def check_passages(v: Views):
    counts = v.sig.groupBy("session_id").agg(F.max("frame").alias("frame_count"))
    return checks.check_passages(reviewed_passages(v), KEY, counts)


@register(
    "check_span_occlusion",
    ANNOTATED + SPANS_CTE + """
--
SELECT a.session_id, 'span_contradicts_occlusion' AS rule, CAST(a.frame AS VARCHAR) AS key
FROM a JOIN sig USING (session_id, frame, event_id) JOIN spans s ON s.session_id = a.session_id
 AND s.start_s <= sig.time_s + (CASE WHEN a.event_id % 14 = 0 THEN 1 ELSE 0 END)
 AND sig.time_s + (CASE WHEN a.event_id % 14 = 0 THEN 1 ELSE 0 END) < s.end_s
WHERE a.event_id % 9 = 0""",
)
def check_span_occlusion(v: Views):
    return checks.check_span_occlusion(v.spans, annotation_frames(v), v.axis)


@register(
    "review_counts",
    PASSAGES_REVIEWED + """, f AS (
  SELECT session_id, count(*) FILTER (WHERE event_id % 12 = 0 OR event_id % 5 <> 0) AS readable_speed,
         count(*) FILTER (WHERE v IS NOT NULL OR event_id % 22 = 0) AS readable_brake,
         count(k) AS readable_throttle, count(*) FILTER (WHERE event_id % 4 = 0) AS degraded_frames
  FROM sig WHERE event_type IN ('purchase', 'click') GROUP BY session_id
), c AS (
  SELECT session_id, count(DISTINCT CASE WHEN kind = 'pedal_event' THEN win END) AS event_windows,
         count(*) FILTER (WHERE kind = 'lap_boundary' AND physical) AS passages
  FROM p GROUP BY session_id
)
--
SELECT session_id, coalesce(readable_speed, 0) AS readable_speed,
       coalesce(readable_brake, 0) AS readable_brake, coalesce(readable_throttle, 0) AS readable_throttle,
       coalesce(degraded_frames, 0) AS degraded_frames, coalesce(event_windows, 0) AS event_windows,
       coalesce(passages, 0) AS passages
FROM f FULL JOIN c USING (session_id)""",
)
def review_counts(v: Views):
    return checks.review_counts(annotation_frames(v), reviewed_passages(v), KEY)


def approvals(v: Views):
    """Purchases approved once, every ninth twice, and of these every third with another value."""
    e = F.col("event_id")
    times = F.when(e % 9 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = v.sig.filter(F.col("event_type") == "purchase").select("*", F.explode(times).alias("n"))
    value = F.col("value") + F.when((e % 27 == 0) & (F.col("n") == 1), 1.0).otherwise(0.0)
    return rows.select(
        "session_id", "frame", F.concat(F.lit("approval-"), F.col("n")).alias("approval_source"),
        value.alias("speed"), F.col("gear"),
        F.when(e % 2 == 0, F.lit(True)).alias("speed_visible"),
        F.when((F.col("session_id") % 5 == 0) & (F.col("n") == 1), "holdout")
        .otherwise("development").alias("role"),
        F.lit(None).cast("string").alias("recording_id"), F.col("n"),
    )


APPROVALS = SIG + """, ap AS (
  SELECT session_id, event_id, frame, n, 'approval-' || n AS src, gear,
         value + CASE WHEN event_id % 27 = 0 AND n = 1 THEN 1.0 ELSE 0.0 END AS speed,
         CASE WHEN event_id % 2 = 0 THEN TRUE END AS vis,
         CASE WHEN session_id % 5 = 0 AND n = 1 THEN 'holdout' ELSE 'development' END AS role
  FROM sig, range(2) t(n) WHERE event_type = 'purchase' AND (n = 0 OR event_id % 9 = 0)
)"""


@register(
    "consolidate_reviews",
    APPROVALS + """
--
SELECT session_id, frame, min(speed) AS speed, min(gear) AS gear, bool_and(vis) AS speed_visible,
       string_agg(src, ';' ORDER BY src) AS approval_sources
FROM ap GROUP BY session_id, frame HAVING min(speed) = max(speed)""",
    "speed",
)
def consolidate_reviews(v: Views):
    return checks.consolidate_reviews(approvals(v), KEY, ["speed", "gear", "speed_visible"])[0]


@register(
    "consolidate_reviews_conflicts",
    APPROVALS + """
--
SELECT session_id, 'conflicting_readings' AS rule, CAST(frame AS VARCHAR) AS key
FROM ap GROUP BY session_id, frame HAVING min(speed) <> max(speed)
UNION ALL SELECT session_id, 'conflicting_lineage', 'source' FROM ap GROUP BY session_id
HAVING min(role) <> max(role)""",
)
def consolidate_reviews_conflicts(v: Views):
    rows = approvals(v)
    conflicts = checks.consolidate_reviews(rows, KEY, ["speed", "gear", "speed_visible"])[1]
    return conflicts.unionByName(checks.check_lineage(rows, KEY))


@register(
    "latest_events",
    APPROVALS + """
--
SELECT session_id, 'w' || frame // 4 AS id, arg_max(speed, frame * 2 + n) AS speed,
       arg_max(gear, frame * 2 + n) AS gear FROM ap GROUP BY ALL""",
    "speed",
)
def latest_events(v: Views):
    rows = approvals(v).select(
        "session_id", F.concat(F.lit("w"), F.floor(F.col("frame") / 4)).alias("id"), "speed", "gear",
        (F.col("frame") * 2 + F.col("n")).alias("place"),
    )
    return checks.latest_events(rows, KEY, "place")


#: A case is a stretch of so many frames, as many as a session has.
CASE_FRAMES = 75
CASE_KEY = ("session_id", "case_no")


def _case_no():
    return F.floor(F.col("frame") / CASE_FRAMES).alias("case_no")


def case_passages(v: Views):
    """Two or three passages per case of a session, with planted faults."""
    s, i = F.col("session_id"), F.col("i")
    n = F.when(s % 6 == 0, 4).when(s % 6 == 1, 2).otherwise(3)
    cases = v.sig.select("session_id", _case_no()).distinct()
    rows = cases.select("session_id", "case_no", F.explode(F.sequence(F.lit(1), n)).alias("i"))
    base = F.col("case_no") * CASE_FRAMES + (i * 15).cast("long")
    exit_ = F.when(s % 4 != 1, base + 9)
    return rows.select(
        *CASE_KEY, F.concat(F.lit("p"), F.when(s % 10 == 0, 1).otherwise(i)).alias("id"),
        base.alias("window_lo"), (base + 12).alias("window_hi"), (base + 1).alias("entry_lo"),
        (base + 2).alias("entry_hi"), exit_.alias("exit_lo"),
        F.when(s % 8 == 3, exit_ - 1).otherwise(exit_ + 1).alias("exit_hi"),
        F.when(s % 9 == 4, F.lit(0.0)).otherwise(F.lit(30.0)).alias("max_review_gap_s"),
    ).distinct()


def case_frames(v: Views):
    by = F.sequence(F.col("window_lo"), F.col("window_hi"))
    rows = case_passages(v).select(*CASE_KEY, "id", "window_lo", F.explode(by).alias("frame"))
    offset = F.col("frame") - F.col("window_lo")
    return rows.filter((F.col("session_id") % 7 != 2) | (offset != 2)).select(
        *CASE_KEY, "id", "frame"
    ).distinct()


CASE = SIG + """, bases AS (
  SELECT DISTINCT session_id, case_no, i, case_no * 75 + i * 15 AS base
  FROM (SELECT DISTINCT session_id, frame // 75 AS case_no FROM sig), range(1, 5) t(i)
  WHERE i <= CASE session_id % 6 WHEN 0 THEN 4 WHEN 1 THEN 2 ELSE 3 END
), cp AS (
  SELECT DISTINCT session_id, case_no, 'p' || CASE WHEN session_id % 10 = 0 THEN 1 ELSE i END AS id,
         base AS window_lo, base + 12 AS window_hi, base + 1 AS entry_lo, base + 2 AS entry_hi,
         CASE WHEN session_id % 4 <> 1 THEN base + 9 END AS exit_lo,
         CASE WHEN session_id % 4 <> 1 THEN base + CASE WHEN session_id % 8 = 3 THEN 8 ELSE 10 END END
           AS exit_hi,
         CASE WHEN session_id % 9 = 4 THEN 0.0 ELSE 30.0 END AS gap
  FROM bases
), cf AS (
  SELECT DISTINCT session_id, case_no, id, window_lo + o AS frame FROM cp, range(13) t(o)
  WHERE session_id % 7 <> 2 OR o <> 2
), timed AS (
  SELECT cf.*, sig.time_s, cp.window_lo, cp.window_hi, cp.entry_lo, cp.exit_hi, cp.gap
  FROM cf LEFT JOIN sig USING (session_id, frame) JOIN cp USING (session_id, case_no, id)
), sp AS (
  SELECT session_id, case_no, id,
         time_s - lag(time_s) OVER (PARTITION BY session_id, case_no, id ORDER BY frame) AS d, gap
  FROM timed WHERE frame BETWEEN entry_lo AND exit_hi
)"""

_REVIEWED = "EXISTS (FROM cf WHERE cf.session_id = cp.session_id AND cf.case_no = cp.case_no AND cf.id = cp.id AND cf.frame = {})"


@register(
    "check_case",
    CASE + f""", r AS (
  SELECT session_id, case_no, 'passage_count' AS rule, 'case' AS key FROM cp GROUP BY session_id, case_no
    HAVING count(*) NOT BETWEEN 2 AND 3
  UNION ALL SELECT session_id, case_no, 'repeated_passage', 'case' FROM cp GROUP BY session_id, case_no
    HAVING count(*) > count(DISTINCT id)
  UNION ALL SELECT session_id, case_no, 'entry_unreviewed', id FROM cp
    WHERE NOT {_REVIEWED.format("entry_lo")} OR NOT {_REVIEWED.format("entry_hi")}
  UNION ALL SELECT session_id, case_no, 'exit_unreviewed', id FROM cp WHERE exit_lo IS NOT NULL AND (
       NOT {_REVIEWED.format("exit_lo")} OR NOT {_REVIEWED.format("exit_hi")})
  UNION ALL SELECT session_id, case_no, 'exit_order', id FROM cp WHERE exit_lo > exit_hi
  UNION ALL SELECT session_id, case_no, 'invalid_gap', id FROM cp WHERE exit_lo IS NOT NULL AND gap <= 0
  UNION ALL SELECT DISTINCT session_id, case_no, 'review_spacing', id FROM sp WHERE d > gap + 1e-9
  UNION ALL SELECT session_id, case_no, 'frame_outside', CAST(frame AS VARCHAR) FROM timed
    WHERE time_s IS NULL OR frame NOT BETWEEN window_lo AND window_hi
)
--
SELECT session_id, case_no, rule, key FROM r""",
)
def check_case(v: Views):
    samples = v.sig.select("session_id", _case_no(), "frame", "time_s")
    return checks.check_case(case_passages(v), case_frames(v), samples, CASE_KEY, axis=v.axis.within("case_no"))


# --- sources and sinks ----------------------------------------------------------------


@register(
    "read_csv_records",
    SIG + """
--
SELECT session_id, frame, time_s AS time, CASE WHEN event_id % 23 = 0 THEN NULL ELSE value END AS speed,
       CASE WHEN event_id % 19 = 0 THEN NULL ELSE gear END AS gear,
       CASE WHEN event_id % 20 = 0 THEN 'N/A' WHEN event_id % 6 = 0 THEN ''
            ELSE '0' || CAST(k AS INT) END AS speed_raw,
       CASE WHEN q = 'observed' THEN '' ELSE 'brake_pct:' || q END AS quality_hint, 'a;b' AS s_reasons
FROM sig""",
    "time speed",
)
def read_csv_records(v: Views):
    rows = raw_records(v)
    e = F.col("event_id")
    k = v.sig.select("session_id", "frame", "k", F.col("event_id").alias("eid"))
    rows = rows.withColumn("f", F.col("frame").cast("long")).join(
        k.withColumnRenamed("frame", "f"), ["session_id", "f"]
    )
    raw = F.concat(F.lit("0"), F.col("k").cast("int").cast("string"))
    text = F.when(e % 20 == 0, "N/A").when(e % 6 == 0, "").otherwise(raw)
    rows = rows.withColumn("speed_raw", text)
    names = ("session_id", *tables.LEGACY_COLUMNS, *tables.MODERN_COLUMNS)
    blank = F.lit("")
    rows = rows.select(*[(F.col(n) if n in rows.columns else blank).alias(n) for n in names])
    path = scratch(v, "records")
    tables.write_session(rows, path, form="csv", by=())
    back = tables.read_csv_records(v.spark, path)
    return back.select(F.col("session_id").cast("long").alias("session_id"), "frame", "time", "speed",
                       "gear", "speed_raw", "quality_hint", "s_reasons")


@register(
    "read_legacy_records",
    SIG + """
--
SELECT session_id, frame, time_s AS time, value AS speed, gear,
       CASE WHEN session_id % 3 = 1 THEN NULL ELSE v END AS brake,
       CASE WHEN session_id % 3 = 1 THEN '' WHEN q = 'observed' THEN '' ELSE 's:' || q END AS quality_hint,
       CASE WHEN session_id % 3 = 2 THEN k END AS s_fused
FROM sig""",
    "time speed brake s_fused",
)
def read_legacy_records(v: Views):
    """Files of three headers side by side: with a hint after the legacy columns, without brake, in another order."""
    q = F.when(F.col("q") == "observed", "").otherwise(F.concat(F.lit("s:"), F.col("q")))
    columns = {
        "frame": F.col("frame"), "time": F.col("time_s"), "speed": F.col("value"), "gear": F.col("gear"),
        "brake": F.col("v"), "quality_hint": q, "s_fused": F.col("k"), "session_id": F.col("session_id"),
        "unknown_column": F.lit("x"),
    }
    rest = [n for n in tables.LEGACY_COLUMNS if n not in columns]
    forms = (
        ["session_id", *tables.LEGACY_COLUMNS, "quality_hint"],
        ["session_id", *(n for n in tables.LEGACY_COLUMNS if n != "brake")],
        ["unknown_column", "quality_hint", "s_fused", *reversed(tables.LEGACY_COLUMNS), "session_id"],
    )
    path = scratch(v, "legacy")
    for n, names in enumerate(forms):
        blank = F.lit(None).cast("string")
        rows = v.sig.filter(F.col("session_id") % 3 == n)
        rows = rows.select(*[(blank if c in rest else columns[c]).alias(c) for c in names])
        tables.write_session(rows, f"{path}/form={n}", form="csv", by=())
    back = tables.read_csv_records(v.spark, f"{path}/*")
    return back.select(F.col("session_id").cast("long").alias("session_id"), "frame", "time", "speed", "gear",
                       "brake", "quality_hint", "s_fused")


@register(
    "read_samples_jsonl",
    SIG + """
--
SELECT CAST(session_id AS VARCHAR) AS session_id, frame, time_s, time_s + 5 AS source_time_s, lap_number,
       s, value AS speed_kmh, v AS brake_pct, q AS brake_quality, event_type AS brake_reasons
FROM sig""",
    "time_s source_time_s s speed_kmh brake_pct",
)
def read_samples_jsonl(v: Views):
    path = scratch(v, "samples")
    tables.write_session(sample_lines(v).drop("event_id"), path, form="json", by=())
    rows = tables.read_samples_jsonl(v.spark, path)
    return rows.select(
        "session_id", "frame", "time_s", "source_time_s", "lap_number", "s", "speed_kmh", "brake_pct",
        F.col("field_quality")["brake_pct"].alias("brake_quality"),
        F.col("field_reasons")["brake_pct"].alias("brake_reasons"),
    )


@register(
    "read_observations_jsonl",
    OBS + """
--
SELECT CAST(session_id AS VARCHAR) AS session_id, frame, time_s, field, value, quality FROM obs""",
    "time_s value",
)
def read_observations_jsonl(v: Views):
    path = scratch(v, "observations")
    tables.write_session(observation_lines(v), path, form="json", by=())
    rows = tables.read_observations_jsonl(v.spark, path)
    return rows.select("session_id", "frame", "time_s", "field", "value", "quality")


def observation_lines(v: Views):
    def one(value, quality):
        return F.struct(
            value.cast("double").alias("value"), quality.alias("quality"),
            value.cast("string").alias("raw_value"),
            F.array().cast("array<string>").alias("reasons"),
            F.lit(None).cast("double").alias("last_observed_time_s"),
        )

    both = F.create_map(
        F.lit("brake"), one(F.col("v"), F.col("q")),
        F.lit("throttle"), one(F.col("k"), F.lit("observed")),
    )
    return sample_lines(v).drop("sample", "event_id").join(
        v.sig.select(F.col("session_id").cast("string").alias("source_id"), "frame",
                     both.alias("observations")), ["source_id", "frame"],
    )


@register(
    "check_observation_lines",
    SIG + """, kept AS (SELECT * FROM sig WHERE NOT (session_id % 5 = 0 AND event_id % 31 = 0)
), r AS (
  SELECT session_id, 'observation_quality' AS rule, CAST(frame AS VARCHAR) AS key FROM kept WHERE event_id % 23 = 0
  UNION ALL SELECT session_id, 'observation_reasons', CAST(frame AS VARCHAR) FROM kept WHERE event_id % 27 = 0
  UNION ALL SELECT session_id, 'source_time', CAST(frame AS VARCHAR) FROM kept WHERE event_id % 21 = 0
  UNION ALL SELECT session_id, 'foreign_envelope', CAST(frame AS VARCHAR) FROM kept WHERE event_id % 33 = 0
  UNION ALL SELECT session_id, 'misaligned_rows', CAST(frame AS VARCHAR) FROM sig WHERE session_id % 5 = 0 AND event_id % 31 = 0
  UNION ALL SELECT session_id, 'row_count', 'rows' FROM sig GROUP BY session_id
   HAVING session_id % 7 = 3 OR (session_id % 5 = 0 AND count(*) FILTER (WHERE event_id % 31 = 0) > 0)
)
--
SELECT CAST(session_id AS VARCHAR) AS session_id, rule, key FROM r""",
)
def check_observation_lines(v: Views):
    """Observation lines against their manifest, and the rows of samples and observations against each other."""
    source = F.col("session_id").cast("string")
    marks = v.sig.select(source.alias("source_id"), "frame", "event_id")
    e, n = F.col("event_id"), F.col("source_id").cast("long")
    fused, told = F.create_map(F.lit("brake"), F.lit("fused")), F.create_map(F.lit("brake"), F.array(F.lit("x")))
    flags = {name: F.transform_values("observations", lambda _, o: o[name]) for name in ("quality", "reasons")}
    lines = observation_lines(v).join(marks, ["source_id", "frame"]).filter(~((n % 5 == 0) & (e % 31 == 0)))
    lines = lines.withColumns(
        {
            "field_quality": F.when(e % 23 == 0, fused).otherwise(flags["quality"]),
            "field_reasons": F.when(e % 27 == 0, told).otherwise(flags["reasons"]),
            "source_time_s": F.when(e % 21 == 0, F.col("source_time_s") + 1).otherwise(F.col("source_time_s")),
            "profile": F.when(e % 33 == 0, "other").otherwise(F.col("profile")),
            "session_id": F.col("source_id"),
        }
    )
    counts = v.sig.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    manifest = counts.select(
        source.alias("session_id"), source.alias("source_id"), F.lit(tables.SCHEMA_VERSION).alias("schema_version"),
        F.sha2(source, 256).alias("source_sha256"), F.lit("profile").alias("profile"), F.lit(5.0).alias("start_s"),
        (F.col("n") + (F.col("session_id") % 7 == 3).cast("int")).alias("frame_count"),
    )
    key = ("session_id",)
    samples = v.sig.select(source.alias("session_id"), "frame", "time_s")
    found = checks.check_observation_envelope(lines, key, manifest)
    return found.unionByName(checks.check_row_counts(samples, lines, manifest, key))


def _manifests(v: Views):
    # Laps of one session, a short list per document.
    item = F.struct("frame", "time_s", "from_lap", "to_lap")
    laps = v.boundaries.groupBy("session_id").agg(
        F.array_sort(F.collect_list(item)).alias("lap_transitions")
    )
    source = F.col("session_id").cast("string")
    version = F.when(F.col("session_id") % 6 == 5, "telemetry-v1").otherwise(tables.SCHEMA_VERSION)
    return laps.select(
        version.alias("schema_version"), source.alias("source_id"), F.lit("profile").alias("profile"),
        F.size("lap_transitions").cast("long").alias("frame_count"),
        F.struct(F.sha2(source, 256).alias("sha256"), F.col("session_id").alias("size_bytes"))
        .alias("source"),
        F.struct(F.lit(5.0).alias("start_s")).alias("clip_origin"), "lap_transitions",
    )


@register(
    "read_manifest",
    BOUNDED + """
--
SELECT CAST(session_id AS VARCHAR) AS session_id, frame, time_s, from_lap, to_lap FROM boundaries
WHERE session_id % 6 <> 5""",
    "time_s",
)
def read_manifest(v: Views):
    path = scratch(v, "manifest")
    tables.write_session(_manifests(v), path, form="json", by=())
    _, laps, _ = tables.read_manifest(v.spark, path)
    return laps.select("session_id", "frame", "time_s", "from_lap", "to_lap")


@register(
    "read_annotations",
    ANNOTATED + """
--
SELECT CAST(session_id AS VARCHAR) AS session_id, 'frames' AS part, count(*) AS n FROM a GROUP BY ALL
UNION ALL
SELECT CAST(session_id AS VARCHAR), 'passages', count(*) FILTER (WHERE event_type = 'purchase') FROM sig
GROUP BY ALL HAVING count(*) FILTER (WHERE event_type = 'purchase') > 0
UNION ALL
SELECT CAST(session_id AS VARCHAR), 'visibility', CAST(floor(max(time_s) / 24) AS BIGINT) + 1 FROM sig GROUP BY session_id""",
)
def read_annotations(v: Views):
    frame = F.struct("frame", "time_s", "speed_text", "gear_text", "lap_text", "throttle_pct",
                     "brake_pct", "pedal_tolerance_pct", "visibility", "degraded", "reviewed")
    passage = F.struct("id", "kind", "field", "frame_lo", "frame_hi", "reviewed")
    span = F.struct("field", "start_s", "end_s", "reviewer")
    # A document holds the reviewed part of one session, far fewer rows than its samples.
    parts = {
        "frames": annotation_frames(v).groupBy("session_id").agg(F.collect_list(frame).alias("frames")),
        "passages": reviewed_passages(v).groupBy("session_id").agg(
            F.collect_list(passage).alias("passages")),
        "visibility": v.spans.groupBy("session_id").agg(F.collect_list(span).alias("visibility")),
    }
    documents = v.sessions
    for table in parts.values():
        documents = documents.join(table, "session_id", "left")
    path = scratch(v, "annotations")
    documents = documents.withColumn("source_sha256", F.col("session_id").cast("string"))
    tables.write_session(documents.drop("session_id"), path, form="json", by=())
    back = tables.read_annotations(v.spark, path)
    counts = [
        back[p].groupBy("session_id").agg(F.lit(p).alias("part"), F.count(F.lit(1)).alias("n"))
        for p in parts
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@register(
    "read_annotation_values",
    SIG + """, p AS (
  SELECT session_id, event_id, 'p' || event_id AS id, frame FROM sig WHERE event_type = 'purchase'
)
--
SELECT CAST(session_id AS VARCHAR) AS session_id, id, CASE WHEN event_id % 2 = 0 THEN 'l' || event_id % 3 END AS landmark_id,
       CASE WHEN event_id % 3 = 0 THEN event_id % 5.0 END AS threshold_pct, event_id % 7 = 0 AS eligible,
       frame AS frame_lo, 4 AS segment_lo, session_id % 2 = 0 AS complete
FROM p""",
    "threshold_pct",
)
def read_annotation_values(v: Views):
    """Optional fields of passages, target segments and lap reviews, read back from documents by value."""
    e = F.col("event_id")
    passage = F.struct(
        F.concat(F.lit("p"), e).alias("id"), F.lit("landmark").alias("kind"), F.col("frame").alias("frame_lo"),
        F.col("frame").alias("frame_hi"), F.when(e % 2 == 0, F.concat(F.lit("l"), e % 3)).alias("landmark_id"),
        F.when(e % 3 == 0, (e % 5).cast("double")).alias("threshold_pct"),
        (e % 7 == 0).alias("eligible_for_5pct_crossing_latency"),
    )
    # A document holds the reviewed part of one session, far fewer rows than its samples.
    documents = v.sig.filter(F.col("event_type") == "purchase").groupBy("session_id").agg(F.collect_list(passage).alias("passages"))
    segment = F.struct(F.lit(4).cast("long").alias("frame_lo"), F.lit(9).cast("long").alias("frame_hi"))
    review = F.struct(
        F.lit(True).alias("reviewed"), (F.col("session_id") % 2 == 0).alias("complete_real_and_suspect_transitions"),
        F.lit(0).cast("long").alias("frame_lo"),
    )
    documents = documents.select(
        F.col("session_id").cast("string").alias("source_sha256"), "passages",
        F.array(segment).alias("evaluation_segments"), review.alias("lap_review"),
    )
    path = scratch(v, "documents")
    tables.write_session(documents, path, form="json", by=())
    back = tables.read_annotations(v.spark, path)
    segments = back["evaluation_segments"].select("session_id", F.col("frame_lo").alias("segment_lo"))
    laps = back["lap_review"].select("session_id", F.col("complete_real_and_suspect_transitions").alias("complete"))
    rows = back["passages"].join(segments, "session_id").join(laps, "session_id")
    return rows.select("session_id", "id", "landmark_id", "threshold_pct", F.col("eligible_for_5pct_crossing_latency").alias("eligible"),
                       "frame_lo", "segment_lo", "complete")


@register(
    "write_session",
    SIG + "\n--\nSELECT session_id, frame, time_s, v, q FROM sig",
    "time_s v",
)
def write_session(v: Views):
    path = scratch(v, "session")
    rows = v.sig.select("session_id", "frame", "time_s", "v", "q", (F.col("session_id") % 4).alias("part"))
    tables.write_session(rows, path, by=("part",))
    return v.spark.read.parquet(path).drop("part")


# --- composite jobs -------------------------------------------------------------------


@register(
    "lap_report",
    BOUNDED + ZONES_CTE + """, inside AS (
  SELECT l.*, b.lap_number AS lap FROM sig l JOIN bounded b ON l.session_id = b.session_id
   AND l.frame >= b.start_frame AND l.frame < b.end_frame
), ch AS (
  SELECT *, lag(gear) OVER w AS pg, lag(time_s) OVER w AS pt FROM inside
  WINDOW w AS (PARTITION BY session_id, lap ORDER BY frame)
)
--
SELECT c.session_id, c.lap AS lap_number, 'gear_change' AS type, c.frame, z.id AS zone_id
FROM ch c LEFT JOIN zones z ON z.session_id = c.session_id AND c.frame >= z.start_frame
 AND c.frame < z.end_frame
WHERE gear <> pg AND time_s - pt > 0 AND time_s - pt <= 24 + 1e-12""",
)
def lap_report(v: Views):
    found = jobs.lap_report(
        v.sig, bounded(v), v.zones, v.axis, controls=[], steps=[GEAR], settings=SETTINGS,
        frame_time=FRAME_TIME,
    )
    return found["events"].select("session_id", "lap_number", "type", "frame", "zone_id")


# The events rule with the lap as one more key: a lap's rows under a key of their own.
LAP_KEY = """, keyed AS (
  SELECT l.* REPLACE (l.session_id * 1000 + b.lap_number AS session_id) FROM sig l JOIN bounded b
   ON l.session_id = b.session_id AND l.frame >= b.start_frame AND l.frame < b.end_frame
)"""


def _report(v: Views):
    return jobs.lap_report(
        v.sig, bounded(v), v.zones, v.axis, controls=[BRAKE, THROTTLE], steps=[GEAR],
        settings=SETTINGS, frame_time=FRAME_TIME,
    )


@register(
    "lap_report_events",
    BOUNDED + ZONES_CTE + LAP_KEY
    + events_sql("v", BRAKE_OK, "brake", False).replace("FROM sig\n", "FROM keyed\n")
    + events_sql("k", THROTTLE_OK, "throttle", False).replace("FROM sig\n", "FROM keyed\n") + """, every AS (
  SELECT session_id, type, frame, time_s FROM brake_events
  UNION ALL SELECT session_id, type, frame, time_s FROM throttle_events
  UNION ALL SELECT session_id, 'gear_change', frame, time_s FROM (
    SELECT *, lag(gear) OVER w AS pg, lag(time_s) OVER w AS pt FROM keyed WINDOW w AS (PARTITION BY session_id ORDER BY frame))
  WHERE gear <> pg AND time_s - pt > 0 AND time_s - pt <= 24 + 1e-12
)
--
SELECT e.session_id // 1000 AS session_id, e.session_id % 1000 AS lap_number, type || '-' || frame AS id, type, frame, time_s,
       z.id AS zone_id
FROM every e LEFT JOIN zones z ON z.session_id = e.session_id // 1000 AND e.frame >= z.start_frame AND e.frame < z.end_frame""",
    "time_s",
)
def lap_report_events(v: Views):
    return _report(v)["events"].select(
        "session_id", "lap_number", "id", "type", "frame", "time_s", "zone_id"
    )


@register(
    "lap_report_missing",
    BOUNDED + LAP_KEY + """, f AS (
  SELECT session_id, frame, time_s, 'brake' AS field, q = 'observed' AND v IS NOT NULL AS ok FROM keyed
  UNION ALL SELECT session_id, frame, time_s, 'throttle', k IS NOT NULL FROM keyed
  UNION ALL SELECT session_id, frame, time_s, 'gear', gear IS NOT NULL FROM keyed
), g AS (
  SELECT *, row_number() OVER (PARTITION BY session_id, field ORDER BY frame)
          - row_number() OVER (PARTITION BY session_id, field, ok ORDER BY frame) AS island FROM f
)
--
SELECT session_id // 1000 AS session_id, session_id % 1000 AS lap_number, field, min(frame) AS start_frame,
       max(frame) + 1 AS end_frame_exclusive, min(time_s) AS start_time_s, max(time_s) + 1.0 AS end_time_s, count(*) AS frames
FROM g WHERE NOT ok GROUP BY session_id, field, island""",
    "start_time_s end_time_s",
)
def lap_report_missing(v: Views):
    return _report(v)["missing"]


@register(
    "lap_report_available",
    BOUNDED + LAP_KEY + """
--
SELECT session_id // 1000 AS session_id, session_id % 1000 AS lap_number, count(*) AS frames, count(v) AS brake_present,
       count(*) FILTER (WHERE q = 'observed' AND v IS NOT NULL) AS brake_fresh, count(k) AS throttle_present,
       count(k) AS throttle_fresh, count(gear) AS gear_present, count(gear) AS gear_fresh
FROM keyed GROUP BY session_id""",
)
def lap_report_available(v: Views):
    return _report(v)["available"]


@register(
    "case_summary",
    CASE + """
--
SELECT cp.session_id, cp.case_no, cp.id, d.time_s - b.time_s AS range_lo_s, e.time_s - a.time_s AS range_hi_s
FROM cp LEFT JOIN sig a ON a.session_id = cp.session_id AND a.frame = entry_lo
LEFT JOIN sig b ON b.session_id = cp.session_id AND b.frame = entry_hi
LEFT JOIN sig d ON d.session_id = cp.session_id AND d.frame = exit_lo
LEFT JOIN sig e ON e.session_id = cp.session_id AND e.frame = exit_hi""",
    "range_lo_s range_hi_s",
)
def case_summary(v: Views):
    return _case(v)["durations"]


@register(
    "case_speeds",
    CASE + """
--
SELECT cf.session_id, cf.case_no, cf.id, cf.frame, sig.v AS extracted,
       CASE WHEN q = 'observed' AND cf.frame % 3 <> 0 THEN v END AS admitted,
       coalesce(q, 'missing') AS quality, time_s + 5 AS source_time_s
FROM cf LEFT JOIN sig USING (session_id, frame)""",
    "extracted admitted source_time_s",
)
def case_speeds(v: Views):
    return _case(v)["speeds"].drop("hud_kmh")


def _case(v: Views):
    read = v.sig.select("session_id", _case_no(), "frame", "time_s", F.col("v").alias("value"),
                        F.col("q").alias("quality"))
    told = case_frames(v).join(read.select(*CASE_KEY, "frame", "value"), [*CASE_KEY, "frame"], "left")
    shown = F.when(F.col("frame") % 3 == 0, F.col("value") + 1).otherwise(F.col("value"))
    reviews = told.select(*CASE_KEY, "id", "frame", shown.alias("hud_kmh"))
    return jobs.case_summary(case_passages(v), reviews, read, CASE_KEY, start_s=5.0)


@register(
    "evaluate_fields",
    POINTS + """, e AS (
  SELECT field, count(*) AS n, count(prediction) AS m, avg(abs(truth - prediction)) AS mae,
         quantile_cont(abs(truth - prediction), 0.95) AS p95 FROM truth_points GROUP BY field
)
--
SELECT field, CASE WHEN mae IS NULL THEN 'not_evaluated' WHEN mae <= 2 AND p95 <= 5 THEN 'pass'
       ELSE 'fail' END AS accuracy_status,
       CASE WHEN m / n >= 0.95 THEN 'pass' ELSE 'fail' END AS coverage_status FROM e""",
)
def evaluate_fields(v: Views):
    from gapwise.operators import aggregates

    errors = aggregates.field_errors(truth_points(v), ("field",))
    rows = jobs.field_status(errors, ("field",), mae=2.0, p95=5.0, coverage=0.95)
    return rows.select("field", "accuracy_status", "coverage_status")


def _onsets(v: Views):
    found = runs.threshold_crossings(v.sig, v.axis, BRAKE, CROSSING, SETTINGS.max_gap)
    found = found.filter("direction = 'onset'")
    return found.select("session_id", "id", "time_s", F.col("time_s").alias("confirmed_at_s"))


# The matching of ``match_events`` with onsets near a reviewed event in place of clicks.
ONSET_MATCHING = MATCHING.replace(", truth AS (", CROSSINGS_CTE + ", truth AS (", 1).replace(
    """  SELECT session_id, event_id AS id, time_s AS t,
         row_number() OVER (PARTITION BY session_id ORDER BY time_s, event_id) AS j
  FROM sig WHERE event_type = 'click'
""",
    """  SELECT session_id, id, time_s AS t,
         row_number() OVER (PARTITION BY session_id ORDER BY time_s, frame) AS j
  FROM crossings c WHERE direction = 'onset'
   AND EXISTS (FROM truth t WHERE t.session_id = c.session_id AND abs(t.mid - c.time_s) <= 6)
""",
)


@register(
    "evaluate_events",
    ONSET_MATCHING + METRICS_CTE + """, ob AS (
  SELECT session_id, count(*) AS observable_count FROM (
    SELECT t.session_id, t.event_id
    FROM sig t JOIN sig0 f ON f.session_id = t.session_id
     AND f.time_s BETWEEN t.time_s + 0.25 - 6 AND t.time_s + 0.25 + 6
    WHERE t.event_type = 'purchase' GROUP BY t.session_id, t.event_id
    HAVING count(DISTINCT f.time_s) >= 2
     AND bool_and(f.q = 'observed' AND f.v IS NOT NULL AND f.event_id % 17 <> 0)
  ) GROUP BY session_id
)
--
SELECT m.*, coalesce(observable_count, 0) AS observable_count,
       CASE WHEN coalesce(p95_error_s > 0.1, FALSE) THEN 'fail'
            WHEN truth_count = 0 OR coalesce(observable_count, 0) < truth_count THEN 'not_evaluated'
            WHEN missed_count > 0 THEN 'fail' ELSE 'pass' END AS latency_status
FROM metrics m LEFT JOIN ob USING (session_id)""",
    "median_error_s p95_error_s precision recall",
)
def evaluate_events(v: Views):
    """Reviewed events against the onsets near them; lost frames are no evidence."""
    truth = v.sig.filter(F.col("event_type") == "purchase").select(
        "session_id", F.col("event_id").cast("string").alias("id"), F.col("time_s").alias("lo_s"),
        (F.col("time_s") + 0.5).alias("hi_s"),
    )
    fresh = v.sig.select("session_id", "time_s", BRAKE.fresh().alias("fresh"))
    return jobs.evaluate_events(
        truth, _onsets(v), fresh, v.axis, window=MATCH_WINDOW, max_error=0.1, capture=v.sig0
    )


# The same matching between reviewed boundaries and the first sight of confirmed ones, within a day.
LAP_MATCHING = WALK + BOUNDARIES.removeprefix(SIG) + MATCHING[MATCHING.index(", truth AS (") :].replace(
    """  SELECT session_id, event_id AS id, time_s + 0.25 AS mid,
         row_number() OVER (PARTITION BY session_id ORDER BY time_s, event_id) AS i
  FROM sig WHERE event_type = 'purchase'
""",
    """  SELECT session_id, frame AS id, time_s AS mid,
         row_number() OVER (PARTITION BY session_id ORDER BY time_s, frame) AS i
  FROM boundaries
""",
).replace(
    """  SELECT session_id, event_id AS id, time_s AS t,
         row_number() OVER (PARTITION BY session_id ORDER BY time_s, event_id) AS j
  FROM sig WHERE event_type = 'click'
""",
    """  SELECT session_id, frame AS id, first_t AS t,
         row_number() OVER (PARTITION BY session_id ORDER BY first_t, frame) AS j
  FROM walk WHERE before IS NOT NULL AND now <> before AND first_t IS NOT NULL
""",
).replace("<= 6", "<= 24")


@register(
    "evaluate_lap_events",
    LAP_MATCHING + METRICS_CTE + """
--
SELECT *, CASE WHEN truth_count = 0 THEN 'not_evaluated'
               WHEN missed_count > 0 OR coalesce(p95_error_s > 12, FALSE) THEN 'fail'
               WHEN session_id % 2 <> 0 THEN 'not_evaluated'
               WHEN duplicate_count + outside_count > 0 THEN 'fail' ELSE 'pass' END AS gate_status
FROM metrics""",
    "median_error_s p95_error_s precision recall",
)
def evaluate_lap_events(v: Views):
    """Reviewed lap boundaries against confirmed ones."""
    states = labels.confirm_labels(v.sig, v.axis, "raw_lap", LABEL_COUNT)
    truth = v.boundaries.select(
        "session_id", F.col("frame").alias("id"), F.col("time_s").alias("lo_s"),
        F.col("time_s").alias("hi_s"),
    )
    return jobs.evaluate_laps(
        truth, labels.boundaries(states, v.axis), v.axis, window=24.0, max_error=12.0,
        complete_review=F.col("session_id") % 2 == 0,
    )


@register(
    "false_observed",
    ANNOTATED + """
--
SELECT DISTINCT a.session_id, a.frame FROM a JOIN sig USING (session_id, frame)
WHERE a.event_id % 9 = 0 AND sig.q = 'observed' AND sig.v IS NOT NULL""",
)
def false_observed(v: Views):
    samples = v.sig.select("session_id", "frame", BRAKE.fresh().alias("fresh"))
    return jobs.false_observed(annotation_frames(v), samples, KEY, "brake")


@register(
    "observable_truth",
    SIG + """
--
SELECT t.session_id, t.event_id AS id
FROM sig t JOIN sig0 f ON f.session_id = t.session_id
 AND f.time_s BETWEEN t.time_s + 0.25 - 6 AND t.time_s + 0.25 + 6
WHERE t.event_type = 'purchase' GROUP BY t.session_id, t.event_id
HAVING count(DISTINCT f.time_s) >= 2
 AND bool_and(f.q = 'observed' AND f.v IS NOT NULL AND f.event_id % 17 <> 0)""",
)
def observable_truth(v: Views):
    truth = v.sig.filter(F.col("event_type") == "purchase").select(
        "session_id", F.col("event_id").alias("id"), F.col("time_s").alias("lo_s"),
        (F.col("time_s") + 0.5).alias("hi_s"),
    )
    fresh = v.sig.select("session_id", "time_s", BRAKE.fresh().alias("fresh"))
    return jobs.observable_truth(truth, fresh, KEY, MATCH_WINDOW, v.sig0)


@register(
    "landmark_positions",
    SIG + """, l AS (
  SELECT session_id, 'l' || event_id % 3 AS landmark_id, CASE WHEN q = 'observed' THEN s END AS s
  FROM sig WHERE event_type IN ('purchase', 'error')
), o AS (
  SELECT *, s - lag(s) OVER (PARTITION BY session_id, landmark_id ORDER BY s) AS gap
  FROM l WHERE s IS NOT NULL
), r AS (
  SELECT session_id, landmark_id, count(*) AS n,
         1 - greatest(coalesce(max(gap), 0), min(s) + 1 - max(s)) AS r FROM o GROUP BY ALL
)
--
SELECT session_id, landmark_id, count(*) AS denominator, coalesce(any_value(n), 0) AS measured_count,
       any_value(CASE WHEN n >= 2 THEN r END) AS range_s,
       CASE WHEN any_value(n) >= 2 THEN 'available' ELSE 'not_evaluated' END AS status
FROM l LEFT JOIN r USING (session_id, landmark_id) GROUP BY session_id, landmark_id""",
    "range_s",
)
def landmark_positions(v: Views):
    marks = v.sig.filter(F.col("event_type").isin("purchase", "error")).select(
        "session_id", F.concat(F.lit("l"), F.col("event_id") % 3).alias("landmark_id"),
        F.col("event_id").alias("id"), F.col("frame").alias("frame_lo"),
        F.col("frame").alias("frame_hi"),
    )
    read = v.sig.select("session_id", "frame", "s", F.col("q").alias("s_quality"))
    return jobs.landmark_positions(marks, read, KEY)


ANNOTATION_EVENTS = SIG + episodes_sql("v", BRAKE_OK, "brake") + episodes_sql(
    "k", THROTTLE_OK, "throttle"
) + """, events_x AS (
  SELECT *, 'brake' AS field FROM brake_events UNION ALL SELECT *, 'throttle' FROM throttle_events
)"""


def _annotation_parts(v: Views):
    marked = episodes.marked_episodes(v.sig, v.axis, [BRAKE, THROTTLE], SETTINGS)
    events = runs.events_of(marked, v.axis.within("field"))
    found = materialize(episodes.episodes_of(marked, v.axis))
    points = v.sig.filter(F.col("event_id") % 5 == 0).select(
        "session_id", "frame", F.lit("brake").alias("field"), F.col("value").alias("truth"),
        F.when(BRAKE.valid(), F.col("v")).alias("prediction"),
    )
    return jobs.compare_annotations(
        events, found, points,
        passages(v), v.segments, v.spans.filter("state = 'visible'"), KEY, FRAME_TIME,
    )


@register(
    "compare_annotations_events",
    ANNOTATION_EVENTS + PASSAGES_CTE + UNIQUE_CTE + "\n--\nSELECT * FROM comparisons",
    "offset_lo_s offset_hi_s",
)
def compare_annotations_events(v: Views):
    return _annotation_parts(v)["event_comparisons"]


@register(
    "compare_annotations_visibility",
    ANNOTATION_EVENTS + SPANS_CTE + """
--
SELECT e.session_id, e.id, greatest(e.start_time_s, s.start_s) AS start_time_s,
       least(e.end_time_s, s.end_s) AS end_time_s
FROM brake_episodes e JOIN spans s ON s.session_id = e.session_id AND s.state = 'visible'
 AND greatest(e.start_time_s, s.start_s) < least(e.end_time_s, s.end_s)""",
    "start_time_s end_time_s",
)
def compare_annotations_visibility(v: Views):
    return _annotation_parts(v)["visibility_intersections"]


@register(
    "compare_annotations_points",
    ANNOTATION_EVENTS + """
--
SELECT e.session_id, e.id, count(*) AS numeric_frames
FROM brake_episodes e JOIN sig p ON p.session_id = e.session_id AND p.event_id % 5 = 0
 AND p.frame BETWEEN e.start_frame AND e.end_frame GROUP BY ALL""",
)
def compare_annotations_points(v: Views):
    return _annotation_parts(v)["numeric_frames"]


EPISODE_PARTS = {
    "episode_job_overlaps": (
        "overlaps", EPISODES + OVERLAPS_CTE + "\n--\nSELECT * FROM common",
        "start_time_s end_time_s observed_duration_s",
    ),
    "episode_job_episodes": (
        "episodes",
        EPISODES + "\n--\nSELECT * FROM brake_episodes UNION ALL SELECT * FROM throttle_episodes",
        EPISODE_DOUBLES,
    ),
}

for _name, (_part, _sql, _doubles) in EPISODE_PARTS.items():

    @register(_name, _sql, _doubles)
    def episode_job(v: Views, part=_part):
        found = jobs.episode_job(v.sig, v.axis, BRAKE, THROTTLE, SETTINGS, FRAME_TIME)
        return found[part]


# --- streams --------------------------------------------------------------------------


STREAM_PARTS = 4


def run_stream(v: Views, rows, transform, form: str = "parquet"):
    """Feed rows to a stream in frame order, in a few arrivals, and return all its output.

    Every arrival is one run over all new files with the same state, so a session's rows
    meet the state of earlier arrivals.  Files, state and output lie in the shared folder.
    """
    source, out, state, staged = (
        scratch(v, n) for n in ("stream-in", "stream-out", "stream-state", "stream-staged")
    )
    part = F.least(F.floor(F.col("frame") / 25), F.lit(STREAM_PARTS - 1)).cast("int")
    rows.withColumn("_part", part).write.partitionBy("_part").parquet(staged)
    arrivals = v.spark.read.parquet(staged)
    conf = "spark.sql.streaming.stateStore.providerClass"
    v.spark.conf.set(
        conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )
    for number in range(STREAM_PARTS):
        arrived = arrivals.filter(F.col("_part") == number).drop("_part")
        arrived.write.mode("append").format(form).save(source)
        stream = causal.observation_stream(v.spark, source, rows.schema, form)
        writer = transform(stream).writeStream.format("parquet").option("checkpointLocation", state)
        writer.trigger(availableNow=True).start(out).awaitTermination()
    return v.spark.read.schema(transform(stream).schema).parquet(out)


@register(
    "stream_observations",
    SIG + "\n--\nSELECT session_id, frame, time_s, v, q FROM sig",
    "time_s v",
)
def stream_observations(v: Views):
    return run_stream(v, v.sig.select("session_id", "frame", "time_s", "v", "q"), lambda s: s)


@register(
    "stream_labels",
    WALK + """
--
SELECT session_id, frame, CAST(now AS BIGINT) AS confirmed_label,
       before IS NOT NULL AND now <> before AS is_boundary FROM walk""",
)
def stream_labels(v: Views):
    rows = v.sig.select("session_id", "frame", "time_s", "raw_lap")
    out = run_stream(v, rows, lambda s: causal.stream_labels(s, "raw_lap", LABEL_COUNT))
    return out.select("session_id", "frame", "confirmed_label", "is_boundary")


@register("stream_admission", ORACLES["admit_rate"])
def stream_admission(v: Views):
    rows = v.sig.select("session_id", "frame", "time_s", "value", "q")
    out = run_stream(
        v,
        rows,
        lambda s: causal.stream_admission(
            s, max_rate=MAX_RATE, max_gap=MAX_RATE_GAP, value="value", quality="q"
        ),
    )
    return out.select("session_id", "frame", F.col("admitted").alias("value"),
                      F.col("admitted_quality").alias("quality"), "admission_reason")


@register(
    "stream_events",
    SIG + events_sql("v", BRAKE_OK, "brake", False) + """
--
SELECT session_id, type, frame, time_s, confirmed_frame, confirmed_at_s, previous_evidence_time_s,
       value FROM brake_events""",
    "time_s confirmed_at_s previous_evidence_time_s value",
)
def stream_events(v: Views):
    rows = v.sig.select("session_id", "frame", "time_s", "v", "q")
    return run_stream(
        v, rows, lambda s: causal.stream_events(s, SETTINGS, name="brake", value="v", quality="q")
    )


@register(
    "stream_last_observed",
    OBS + """
--
SELECT session_id, field, frame, last_value(CASE WHEN quality = 'observed' THEN time_s END IGNORE NULLS)
         OVER (PARTITION BY session_id, field ORDER BY frame) AS last_observed_time_s
FROM obs""",
    "last_observed_time_s",
)
def stream_last_observed(v: Views):
    rows = v.obs.select("session_id", "field", "frame", "time_s", "quality")
    out = run_stream(v, rows, causal.stream_last_observed)
    return out.select("session_id", "field", "frame", "last_observed_time_s")


@register("stream_fusion", ORACLES["fuse_progress"])
def stream_fusion(v: Views):
    out = run_stream(v, fuse_input(v), lambda s: causal.stream_fusion(s, FUSION))
    return out.select(
        "session_id", "frame", "s_fused", "s_odometry", "s_uncertainty", "s_source", "anchored"
    )

