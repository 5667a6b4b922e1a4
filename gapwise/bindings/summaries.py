"""Queries on joins, summaries and scoring."""

from pyspark.sql import functions as F

from gapwise.bindings.registry import register
from gapwise.bindings.runs import (
    BRAKE_OK, THROTTLE_OK, events_sql,
)
from gapwise.bindings.distance import ODO, odo
from gapwise.bindings.views import (
    BOUNDARIES, BRAKE, LAPS, MATCH_WINDOW, OBS, SEGMENTS_CTE, SETTINGS, SIG, SPANS_CTE, THROTTLE, ZONES_CTE,
    FRAME_TIME, Views,
)
from gapwise.channel import Channel
from gapwise.operators import aggregates, joins, runs, scoring
from gapwise.ordered import asof, materialize

KEY = ("session_id",)


# --- joins ----------------------------------------------------------------------------


@register(
    "align_frames",
    SIG + """, s AS (SELECT session_id, frame, time_s FROM sig WHERE event_id % 40 <> 0),
o AS (
  SELECT session_id, frame, CASE WHEN event_id % 53 = 0 THEN time_s + 1 ELSE time_s END AS time_s
  FROM sig WHERE event_id % 45 <> 0
)
--
SELECT session_id, frame, CASE WHEN s.time_s IS NULL THEN 'missing_sample'
       WHEN o.time_s IS NULL THEN 'missing_observation' ELSE 'time_mismatch' END AS rule
FROM s FULL JOIN o USING (session_id, frame) WHERE s.time_s IS DISTINCT FROM o.time_s""",
)
def align_frames(v: Views):
    e = F.col("event_id")
    late = F.when(e % 53 == 0, F.col("time_s") + 1).otherwise(F.col("time_s"))
    observations = v.sig.filter(e % 45 != 0).withColumn("time_s", late)
    return joins.align_frames(v.sig.filter(e % 40 != 0), observations, KEY)


POINTS = SIG + """, truth_points AS (
  SELECT session_id, frame, event_type AS field, value + event_id % 7 - 3 AS truth,
         CASE WHEN q = 'observed' THEN value END AS prediction
  FROM sig WHERE event_id % 5 = 0
)"""


def truth_points(v: Views):
    truth = v.sig.filter(F.col("event_id") % 5 == 0).select(
        "session_id", "frame", F.col("event_type").alias("field"),
        (F.col("value") + F.col("event_id") % 7 - 3).alias("truth"),
    )
    channel = Channel("value", "value", "q")
    return joins.join_truth_points(truth, v.sig, KEY, channel, "q")


@register(
    "join_truth_points",
    POINTS + "\n--\nSELECT * FROM truth_points",
    "truth prediction",
)
def join_truth_points(v: Views):
    return truth_points(v)


@register(
    "asof_at_or_before",
    BOUNDARIES + ODO + """
--
SELECT b.session_id, b.frame, b.time_s, o.frame AS point_frame, o.distance_m
FROM boundaries b ASOF LEFT JOIN odo o ON b.session_id = o.session_id AND b.time_s >= o.time_s""",
    "time_s distance_m",
)
def asof_at_or_before(v: Views):
    left = v.boundaries.select("session_id", "frame", "time_s")
    right = odo(v).select("session_id", "frame", "time_s", "distance_m")
    rows = asof(left, right, v.axis, "time_s", "time_s", "p", tie="frame")
    return rows.select("session_id", "frame", "time_s", F.col("p.frame").alias("point_frame"),
                       F.col("p.distance_m").alias("distance_m"))


BOTH_EVENTS = SIG + events_sql("v", BRAKE_OK, "brake", False) + events_sql(
    "k", THROTTLE_OK, "throttle", False
) + """, events_x AS (
  SELECT *, 'brake' AS field FROM brake_events UNION ALL SELECT *, 'throttle' FROM throttle_events
)"""


def events_x(v: Views):
    return runs.hysteresis_events(v.sig, v.axis, [BRAKE, THROTTLE], SETTINGS)


@register(
    "assign_zone",
    BOTH_EVENTS + ZONES_CTE + """
--
SELECT e.session_id, e.field, e.type, e.frame, z.id AS zone_id
FROM events_x e LEFT JOIN zones z ON e.session_id = z.session_id
 AND e.frame >= z.start_frame AND e.frame < z.end_frame""",
)
def assign_zone(v: Views):
    rows = joins.assign_zone(events_x(v), v.zones, v.axis)
    return rows.select("session_id", "field", "type", "frame", "zone_id")


PASSAGES_CTE = """, passages AS (
  SELECT session_id, event_id AS id, CASE event_id % 4 WHEN 0 THEN 'brake_on'
         WHEN 1 THEN 'throttle_off' WHEN 2 THEN 'throttle_on'
         ELSE 'throttle_active_unbounded' END AS wanted_type,
         greatest(frame - 1, 0) AS frame_lo, frame AS frame_hi
  FROM sig WHERE event_type = 'purchase'
)""" + SEGMENTS_CTE


def passages(v: Views):
    e = F.col("event_id")
    kind = (
        F.when(e % 4 == 0, "brake_on")
        .when(e % 4 == 1, "throttle_off")
        .when(e % 4 == 2, "throttle_on")
        .otherwise("throttle_active_unbounded")
    )
    return v.sig.filter(F.col("event_type") == "purchase").select(
        "session_id", e.alias("id"), kind.alias("wanted_type"),
        F.greatest(F.col("frame") - 1, F.lit(0)).alias("frame_lo"),
        F.col("frame").alias("frame_hi"),
    )


UNIQUE_CTE = """, found AS (
  SELECT p.session_id, p.id, count(DISTINCT e.frame) AS n, min(e.frame) AS f
  FROM passages p JOIN segments s ON p.session_id = s.session_id
   AND s.frame_lo <= p.frame_lo AND p.frame_hi <= s.frame_hi
  JOIN events_x e ON e.session_id = p.session_id AND e.type = p.wanted_type
   AND e.frame BETWEEN s.frame_lo AND s.frame_hi
  GROUP BY p.session_id, p.id
), comparisons AS (
  SELECT p.session_id, p.id, p.wanted_type, p.frame_lo, p.frame_hi,
         CASE WHEN n = 1 THEN f END AS event_frame,
         CAST(CASE WHEN n = 1 THEN f - p.frame_hi END AS DOUBLE) AS offset_lo_s,
         CAST(CASE WHEN n = 1 THEN f - p.frame_lo END AS DOUBLE) AS offset_hi_s,
         CASE WHEN n = 1 THEN 'unique_candidate_in_existing_window' ELSE 'absent_or_ambiguous' END
           AS status
  FROM passages p LEFT JOIN found USING (session_id, id)
)"""


@register(
    "unique_event_in_window",
    BOTH_EVENTS + PASSAGES_CTE + UNIQUE_CTE + "\n--\nSELECT * FROM comparisons",
    "offset_lo_s offset_hi_s",
)
def unique_event_in_window(v: Views):
    return joins.unique_event_in_window(passages(v), v.segments, events_x(v), KEY, FRAME_TIME)


def _refresh(v: Views):
    e = F.col("event_id")
    samples = v.sig.select(
        "session_id", "frame", F.col("v").alias("value"), F.col("q").alias("quality"),
        F.when(e % 33 == 0, F.col("v") + 1).otherwise(F.col("v")).alias("obs_value"),
        F.col("q").alias("obs_quality"),
    )
    readings = v.sig.select(
        "session_id", "frame",
        F.when(e % 27 == 0, F.lit(120.0)).otherwise(F.col("k")).alias("new_value"),
        F.when(e % 25 == 0, "missing").otherwise("observed").alias("new_quality"),
    )
    return joins.replace_readings(samples, readings, KEY)


@register(
    "replace_readings",
    SIG + """
--
SELECT session_id, frame, q = 'observed' AND event_id % 33 <> 0 AND event_id % 27 <> 0
         AND event_id % 25 <> 0 AS replaced, q AS quality, q AS obs_quality,
       CASE WHEN q = 'observed' AND event_id % 33 <> 0 AND event_id % 27 <> 0
            AND event_id % 25 <> 0 THEN k ELSE v END AS value,
       CASE WHEN q = 'observed' AND event_id % 33 <> 0 AND event_id % 27 <> 0
            AND event_id % 25 <> 0 THEN k WHEN event_id % 33 = 0 THEN v + 1 ELSE v END AS obs_value
FROM sig""",
    "value obs_value",
)
def replace_readings(v: Views):
    return _refresh(v)[0]


@register(
    "replace_readings_violations",
    SIG + """
--
SELECT session_id, CASE WHEN event_id % 33 = 0 THEN 'prior_disagreement'
       ELSE 'lost_fresh_evidence' END AS rule, CAST(frame AS VARCHAR) AS key
FROM sig WHERE q = 'observed'
 AND (event_id % 33 = 0 OR event_id % 27 = 0 OR event_id % 25 = 0)""",
)
def replace_readings_violations(v: Views):
    return _refresh(v)[1]


@register(
    "broadcast_lap_time",
    LAPS + """, t AS (
  SELECT session_id, lap_number, max(time_s) - min(time_s) AS completed_lap_time FROM laps
  GROUP BY ALL
)
--
SELECT session_id, lap_number, frame, completed_lap_time FROM laps
LEFT JOIN t USING (session_id, lap_number)""",
    "completed_lap_time",
)
def broadcast_lap_time(v: Views):
    span = F.max("time_s") - F.min("time_s")
    times = v.laps.groupBy("session_id", "lap_number").agg(span.alias("completed_lap_time"))
    rows = joins.broadcast_lap_time(v.laps, times, KEY)
    return rows.select("session_id", "lap_number", "frame", "completed_lap_time")


# --- aggregates -----------------------------------------------------------------------


@register(
    "session_summary",
    LAPS + """
--
SELECT session_id, arg_max(time_s, frame) - arg_min(time_s, frame) AS duration,
       count(*) AS total_frames, avg(throttle) AS avg_throttle, max(throttle) AS max_throttle,
       avg(brake) AS avg_brake, max(brake) AS max_brake, avg(abs(steering)) AS avg_steering_abs,
       min(steering) AS max_steering_left, max(steering) AS max_steering_right,
       coalesce(avg(speed), 0) AS avg_speed, coalesce(max(speed), 0) AS max_speed,
       CAST(sum(tc) AS BIGINT) AS tc_frames, avg(tc) * 100 AS tc_percentage,
       CAST(sum(laps.abs) AS BIGINT) AS abs_frames, avg(laps.abs) * 100 AS abs_percentage,
       min(s) AS min_position, max(s) AS max_position, bool_or(s IS NOT NULL) AS position_tracked,
       count(DISTINCT lap_number) AS total_laps
FROM laps GROUP BY session_id""",
    "duration avg_throttle max_throttle avg_brake max_brake avg_steering_abs max_steering_left "
    "max_steering_right avg_speed max_speed tc_percentage abs_percentage min_position max_position",
)
def session_summary(v: Views):
    return aggregates.session_summary(v.laps, KEY)


@register(
    "lap_summary",
    LAPS + """
--
SELECT session_id, lap_number, arg_max(time_s, frame) - arg_min(time_s, frame) AS duration,
       count(*) AS frames, avg(throttle) AS avg_throttle, avg(brake) AS avg_brake,
       max(throttle) AS max_throttle, max(brake) AS max_brake,
       avg(abs(steering)) AS avg_steering_abs, avg(speed) AS avg_speed, max(speed) AS max_speed
FROM laps WHERE lap_number IS NOT NULL GROUP BY session_id, lap_number""",
    "duration avg_throttle avg_brake max_throttle max_brake avg_steering_abs avg_speed max_speed",
)
def lap_summary(v: Views):
    return aggregates.lap_summary(v.laps, KEY)


@register(
    "coverage",
    SIG + """
--
SELECT session_id, count(*) AS frames, count(v) AS brake_present,
       count(*) FILTER (WHERE q = 'observed' AND v IS NOT NULL) AS brake_fresh,
       count(k) AS throttle_present, count(k) AS throttle_fresh
FROM sig GROUP BY session_id""",
)
def coverage(v: Views):
    return aggregates.coverage(v.sig, KEY, [BRAKE, THROTTLE])


@register(
    "field_errors",
    POINTS + """
--
SELECT field, count(*) AS denominator, count(prediction) AS measured_count,
       avg(abs(truth - prediction)) AS mae, quantile_cont(abs(truth - prediction), 0.95) AS p95,
       count(*) - count(prediction) AS abstentions, count(prediction) / count(*) AS coverage,
       CASE WHEN count(prediction) > 0 THEN 'available' ELSE 'not_evaluated' END AS status
FROM truth_points GROUP BY field""",
    "mae p95 coverage",
)
def field_errors(v: Views):
    return aggregates.field_errors(truth_points(v), ("field",))


@register(
    "point_metrics",
    POINTS + """
--
SELECT session_id, field, count(*) AS annotated_points, count(prediction) AS available,
       avg(abs(truth - prediction)) AS mae, max(abs(truth - prediction)) AS max_error
FROM truth_points GROUP BY session_id, field""",
    "mae max_error",
)
def point_metrics(v: Views):
    return aggregates.point_metrics(truth_points(v), ("session_id", "field"))


@register(
    "circular_range",
    """WITH p AS (
  SELECT user_id, (epoch_us(ts) % 86400000000) / 8.64e10 AS s FROM events
), g AS (
  SELECT user_id, s, s - lag(s) OVER (PARTITION BY user_id ORDER BY s) AS gap FROM p
), a AS (
  SELECT user_id, count(*) AS n, greatest(coalesce(max(gap), 0), min(s) + 1 - max(s)) AS widest
  FROM g GROUP BY user_id
)
--
SELECT user_id, n AS measured_count, CASE WHEN n >= 2 THEN 1 - widest END AS range_s,
       CASE WHEN n >= 2 THEN 'available' ELSE 'not_evaluated' END AS status
FROM a""",
    "range_s",
)
def circular_range(v: Views):
    day = (F.col("us") % F.lit(86400000000)) / 8.64e10
    return aggregates.circular_range(v.events.withColumn("s", day), ("user_id",), "s")


CORPUS = """WITH corpus AS (
  SELECT d.source, sum(quality) AS readable, sum(toxic) AS degraded, count(*) AS events,
         count(*) // 2 AS passages, count(*) > 3 AS reviewed,
         CASE WHEN length(d.source) % 2 = 0 THEN 'development' ELSE 'holdout' END AS role
  FROM documents d JOIN labels l USING (doc_id) GROUP BY d.source
)"""


def corpus(v: Views):
    rows = v.table("documents").select("doc_id", "source").join(v.table("labels"), "doc_id")
    n = F.count(F.lit(1))
    return rows.groupBy("source").agg(
        F.sum("quality").alias("readable"), F.sum("toxic").alias("degraded"), n.alias("events"),
        F.floor(n / 2).alias("passages"),
        F.when(n > 3, "pass").otherwise("not_evaluated").alias("status"),
    ).withColumns(
        {
            "role": F.when(F.length("source") % 2 == 0, "development").otherwise("holdout"),
            "recording_id": F.col("source"),
        }
    )


@register(
    "corpus_readiness",
    CORPUS + """, t AS (
  SELECT count(*) AS n, min(passages) AS p, count(DISTINCT role) AS r, sum(readable) AS rd,
         sum(degraded) AS d, sum(events) AS e, bool_and(reviewed) AS rv FROM corpus
), c AS (
  SELECT unnest(['sources', 'recording_lineage', 'repeated_passages', 'roles', 'readable',
                 'degraded', 'events', 'reviewed']) AS check,
         unnest([n >= 2, TRUE, p >= 2, r = 2, rd >= 100, d >= 20, e >= 20, rv]) AS passed FROM t
)
--
SELECT CASE WHEN bool_and(passed) OVER () THEN 'pass' ELSE 'not_evaluated' END AS status,
       "check", passed FROM c""".replace("AS check,", 'AS "check",'),
)
def corpus_readiness(v: Views):
    return aggregates.corpus_readiness(corpus(v))


CHECKS_CTE = """, checks AS (
  SELECT session_id, name AS "check",
         CASE (session_id + i) % 3 WHEN 0 THEN 'pass' WHEN 1 THEN
              CASE WHEN session_id % 4 = 0 THEN 'fail' ELSE 'pass' END
              ELSE CASE WHEN session_id % 5 = 0 THEN 'pass' ELSE 'not_evaluated' END END AS status,
         session_id % 7 <> 0 AS compatible
  FROM (SELECT DISTINCT session_id FROM sig), (VALUES (0, 'software_regressions'),
    (1, 'lap_events'), (2, 'field_accuracy'), (3, 'field_coverage'), (4, 'timebase'),
    (5, 'holdout')) t(i, name)
  WHERE NOT (session_id % 6 = 0 AND i = 5)
)"""


def checks(v: Views):
    s, i = F.col("session_id"), F.col("i")
    names = F.array(*[F.lit(c) for c in aggregates.CHECKS])
    rows = v.sessions.select("session_id", F.posexplode(names).alias("i", "check"))
    status = (
        F.when((s + i) % 3 == 0, "pass")
        .when((s + i) % 3 == 1, F.when(s % 4 == 0, "fail").otherwise("pass"))
        .otherwise(F.when(s % 5 == 0, "pass").otherwise("not_evaluated"))
    )
    rows = rows.filter(~((s % 6 == 0) & (i == 5)))
    return rows.select("session_id", "check", status.alias("status"),
                       (s % 7 != 0).alias("compatible"))


@register(
    "gate_report",
    SIG + CHECKS_CTE + """, g AS (
  SELECT session_id, count(*) AS n, count(*) FILTER (WHERE status = 'fail') AS fails,
         count(*) FILTER (WHERE status = 'pass') AS passes, bool_and(compatible) AS c
  FROM checks GROUP BY session_id
)
--
SELECT session_id, CASE WHEN fails > 0 THEN 'fail' WHEN passes = 6 AND c THEN 'pass'
         ELSE 'not_evaluated' END AS status, fails = 0 AND passes = 6 AND c AS eligible,
       6 - n AS missing_checks, fails AS failed_checks
FROM g""",
)
def gate_report(v: Views):
    return aggregates.gate_report(checks(v), KEY, "compatible")


@register(
    "combine_status",
    SIG + CHECKS_CTE + """
--
SELECT session_id, CASE WHEN bool_or(status = 'fail') THEN 'fail'
       WHEN bool_and(status = 'pass') THEN 'pass' ELSE 'not_evaluated' END AS status
FROM checks GROUP BY session_id""",
)
def combine_status(v: Views):
    return checks(v).groupBy("session_id").agg(
        aggregates.combine_status(F.col("status")).alias("status")
    )


@register(
    "segment_coverage",
    OBS + PASSAGES_CTE + """
--
SELECT *, observed_frames / denominator_frames AS ratio,
       CASE WHEN observed_frames / denominator_frames >= 0.6 THEN 'pass' ELSE 'fail' END AS status
FROM (
  SELECT s.session_id, CAST(any_value(s.whole) AS BIGINT) AS denominator_frames,
         count(*) FILTER (WHERE o.quality = 'observed') AS observed_frames
  FROM (SELECT *, sum(frame_hi - frame_lo + 1) OVER (PARTITION BY session_id) AS whole FROM segments) s
  LEFT JOIN obs o ON o.session_id = s.session_id AND o.frame BETWEEN s.frame_lo AND s.frame_hi
   AND o.field = 'brake'
  GROUP BY s.session_id
)""",
    "ratio",
)
def segment_coverage(v: Views):
    """Frames without a row (every 17th event) count as not fresh."""
    frames = v.obs.filter("field = 'brake'").withColumn("fresh", F.col("quality") == "observed")
    return aggregates.segment_coverage(frames, v.segments, KEY, minimum=0.6)


@register(
    "span_coverage",
    OBS + SPANS_CTE + """
--
SELECT *, CASE WHEN denominator_frames > 0 THEN observed_frames / denominator_frames END AS ratio,
       CASE WHEN denominator_frames = 0 THEN 'not_evaluated'
            WHEN observed_frames / denominator_frames >= 0.6 THEN 'pass' ELSE 'fail' END AS status
FROM (
  SELECT c.session_id, count(DISTINCT c.time_s) FILTER (WHERE s.start_s IS NOT NULL) AS denominator_frames,
         count(DISTINCT c.time_s) FILTER (WHERE s.start_s IS NOT NULL AND o.quality = 'observed') AS observed_frames
  FROM sig0 c LEFT JOIN spans s ON c.session_id = s.session_id AND s.start_s <= c.time_s AND c.time_s < s.end_s
  LEFT JOIN obs o ON o.session_id = c.session_id AND o.frame = c.frame AND o.field = 'brake'
  GROUP BY c.session_id
)""",
    "ratio",
)
def span_coverage(v: Views):
    """All frames of the capture count, also those without a row of their own."""
    frames = v.obs.filter("field = 'brake'").withColumn("fresh", F.col("quality") == "observed")
    return aggregates.segment_coverage(
        frames, v.spans, KEY, span=("start_s", "end_s"), on="time_s", minimum=0.6, half_open=True,
        capture=v.sig0,
    )


PROGRESS = BOUNDARIES + """, progress AS (
  SELECT l.session_id, l.frame, l.time_s, l.lap_number, l.s AS s_odometry,
         CASE WHEN event_id % 19 = 0 THEN NULL
              ELSE least(1.0, greatest(0.0, s + ((event_id % 5) - 2) / 200)) END AS s_fused,
         b.frame IS NOT NULL AS is_boundary,
         CASE WHEN event_id % 19 = 0 THEN 'missing' WHEN event_id % 5 = 0 THEN 'predicted'
              ELSE 'fused' END AS source
  FROM laps l LEFT JOIN boundaries b ON l.session_id = b.session_id AND l.frame = b.frame
)"""


def progress(v: Views):
    e = F.col("event_id")
    moved = F.col("s") + ((e % 5) - 2) / F.lit(200.0)
    fused = F.when(e % 19 != 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), moved)))
    source = F.when(e % 19 == 0, "missing").when(e % 5 == 0, "predicted").otherwise("fused")
    return v.lap_starts.select(
        "session_id", "frame", "time_s", "lap_number", F.col("s").alias("s_odometry"),
        fused.alias("s_fused"), F.col("starts").alias("is_boundary"), source.alias("source"),
    )


@register(
    "source_counts",
    PROGRESS + "\n--\nSELECT session_id, source, count(*) AS n FROM progress GROUP BY ALL",
)
def source_counts(v: Views):
    return aggregates.source_counts(progress(v), KEY, "source")


@register(
    "consistency_counters",
    PROGRESS + """, p AS (
  SELECT *, lag(s_fused) OVER w AS ps, lag(time_s) OVER w AS pt, row_number() OVER w AS i
  FROM progress WINDOW w AS (PARTITION BY session_id ORDER BY frame)
)
--
SELECT session_id, count(*) AS frame_count,
       count(*) FILTER (WHERE is_boundary) AS confirmed_boundary_count,
       count(*) FILTER (WHERE NOT is_boundary AND s_fused >= 0.999
         AND (s_odometry IS NULL OR s_odometry < 0.99)) AS premature_completion_count,
       count(*) FILTER (WHERE NOT is_boundary AND ps >= 0.9 AND s_fused <= 0.1)
         AS unconfirmed_reset_count,
       count(*) FILTER (WHERE NOT is_boundary AND
         abs((s_fused - ps + 0.5) - floor(s_fused - ps + 0.5) - 0.5) > 0.1) AS nonlocal_jump_count,
       coalesce(sum(CASE WHEN i > 1 AND ps IS NULL THEN greatest(0.0, time_s - pt) END), 0.0)
         AS unavailable_duration_s
FROM p GROUP BY session_id""",
    "unavailable_duration_s",
)
def consistency_counters(v: Views):
    return aggregates.consistency_counters(progress(v), v.axis)


@register(
    "checkpoint_spread",
    PROGRESS + """, curve AS (
  SELECT session_id % 5 AS track, session_id * 100 + lap_number AS lap,
         least(1.0, greatest(0.0, (s_odometry - 0.08) / 0.84::DOUBLE)) AS x,
         avg(s_fused) AS y
  FROM progress WHERE s_fused IS NOT NULL GROUP BY ALL
), ok AS (
  SELECT track, lap FROM curve GROUP BY ALL HAVING min(x) <= 0.01 AND max(x) >= 0.99
), c AS (
  SELECT curve.*, lag(x) OVER w AS px, lag(y) OVER w AS py
  FROM curve SEMI JOIN ok USING (track, lap)
  WINDOW w AS (PARTITION BY track, lap ORDER BY x)
), val AS (
  SELECT track, k, CASE WHEN k / 100.0::DOUBLE = x THEN y
                   ELSE py + (k / 100.0::DOUBLE - px) / (x - px) * (y - py) END AS h
  FROM c, range(1, 100) t(k)
  WHERE k / 100.0::DOUBLE = x OR (k / 100.0::DOUBLE > px AND k / 100.0::DOUBLE < x)
), sp AS (
  SELECT track, k, max(h) - min(h) AS spread FROM val GROUP BY ALL HAVING count(*) >= 2
)
--
SELECT track, max(spread) AS max_checkpoint_spread, count(*) AS comparable_checkpoint_count
FROM sp GROUP BY track""",
    "max_checkpoint_spread",
)
def checkpoint_spread(v: Views):
    from dataclasses import replace

    rows = progress(v).withColumns(
        {
            "track": F.col("session_id") % 5,
            "lap_number": F.col("session_id") * 100 + F.col("lap_number"),
            "s_odometry": F.least(
                F.lit(1.0), F.greatest(F.lit(0.0), (F.col("s_odometry") - 0.08) / 0.84)
            ),
        }
    )
    return aggregates.checkpoint_spread(rows, replace(v.axis, keys=("track",)))


@register(
    "cell_frequency",
    """WITH cells AS (
  SELECT vec_id, CAST(floor(embedding[1] * 10) AS BIGINT) AS x,
         CAST(floor(embedding[2] * 10) AS BIGINT) AS y, embedding[3] AS level FROM embeddings
)
--
SELECT x, y, avg((level BETWEEN -0.05 AND 0.1)::INT) AS frequency FROM cells
GROUP BY x, y HAVING avg((level BETWEEN -0.05 AND 0.1)::INT) >= 0.4""",
    "frequency",
)
def cell_frequency(v: Views):
    e = F.col("embedding")
    cells = v.table("embeddings").select(
        F.floor(e[0].cast("double") * 10).alias("x"), F.floor(e[1].cast("double") * 10).alias("y"),
        e[2].cast("double").alias("level"),
    )
    return aggregates.cell_frequency(cells, ("x", "y"), F.col("level").between(-0.05, 0.1), 0.4)


# --- scoring --------------------------------------------------------------------------


def truth_ev(v: Views):
    return v.sig.filter(F.col("event_type") == "purchase").select(
        "session_id", F.col("event_id").alias("id"), F.col("time_s").alias("lo_s"),
        (F.col("time_s") + 0.5).alias("hi_s"),
    )


def pred_ev(v: Views):
    return v.sig.filter(F.col("event_type") == "click").select(
        "session_id", F.col("event_id").alias("id"), "time_s",
        (F.col("time_s") + 0.25).alias("confirmed_at_s"),
    )


def matches(v: Views):
    return scoring.match_events(truth_ev(v), pred_ev(v), v.axis, MATCH_WINDOW)


# The matching as two recursive walks: best scores row by row, then back along the choices.
# A score is the cost less a large amount per pair; a row is the running minimum of its options.
MATCHING = SIG.replace("WITH sig0", "WITH RECURSIVE sig0") + """, truth AS (
  SELECT session_id, event_id AS id, time_s + 0.25 AS mid,
         row_number() OVER (PARTITION BY session_id ORDER BY time_s, event_id) AS i
  FROM sig WHERE event_type = 'purchase'
), pred AS (
  SELECT session_id, event_id AS id, time_s AS t,
         row_number() OVER (PARTITION BY session_id ORDER BY time_s, event_id) AS j
  FROM sig WHERE event_type = 'click'
), p AS (
  SELECT session_id, list(t ORDER BY j) AS ts, count(*) AS m FROM pred GROUP BY session_id
), fwd AS (
  SELECT session_id, CAST(0 AS BIGINT) AS i, ts, m, list_transform(range(m + 1), lambda x: 0.0::DOUBLE) AS r,
         []::BIGINT[] AS choice
  FROM p
  UNION ALL
  SELECT session_id, i, ts, m, nr,
         list_transform(range(1, m + 1), lambda x: CASE WHEN nr[x + 1] = r[x + 1] THEN 0
                        WHEN nr[x + 1] = nr[x] THEN 1 ELSE 2 END)
  FROM (SELECT *, list_transform(range(1, m + 2), lambda x: list_min(cand[1:x])) AS nr
        FROM (SELECT f.session_id, t.i, f.ts, f.m, f.r, list_concat([f.r[1]],
                list_transform(range(1, f.m + 1), lambda x:
                  CASE WHEN abs(t.mid - f.ts[x]) <= 6
                       THEN least(f.r[x + 1], f.r[x] + abs(t.mid - f.ts[x]) - 1e6)
                       ELSE f.r[x + 1] END)) AS cand
              FROM fwd f JOIN truth t ON t.session_id = f.session_id AND t.i = f.i + 1))
), back AS (
  SELECT session_id, max(i) AS i, any_value(m) AS j, CAST(NULL AS BIGINT) AS ti, CAST(NULL AS BIGINT) AS pj
  FROM fwd GROUP BY session_id
  UNION ALL
  SELECT b.session_id, CASE WHEN f.choice[b.j] = 1 THEN b.i ELSE b.i - 1 END,
         CASE WHEN f.choice[b.j] = 0 THEN b.j ELSE b.j - 1 END,
         CASE WHEN f.choice[b.j] = 2 THEN b.i END, CASE WHEN f.choice[b.j] = 2 THEN b.j END
  FROM back b JOIN fwd f ON f.session_id = b.session_id AND f.i = b.i WHERE b.i > 0 AND b.j > 0
), matches AS (
  SELECT b.session_id, t.id AS truth_id, p.id AS prediction_id, t.mid AS annotation_midpoint_s,
         0.25::DOUBLE AS annotation_half_width_s, p.t - t.mid AS signed_error_s,
         abs(p.t - t.mid) AS absolute_error_s, 0.25::DOUBLE AS confirmation_delay_s
  FROM back b JOIN truth t ON t.session_id = b.session_id AND t.i = b.ti
  JOIN pred p ON p.session_id = b.session_id AND p.j = b.pj
), classes AS (
  SELECT t.session_id, 'truth' AS side, t.id,
         CASE WHEN m.truth_id IS NULL THEN 'missed' ELSE 'matched' END AS class
  FROM truth t LEFT JOIN matches m ON m.session_id = t.session_id AND m.truth_id = t.id
  UNION ALL
  SELECT p.session_id, 'prediction', p.id, CASE WHEN m.truth_id IS NOT NULL THEN 'matched'
         WHEN EXISTS (FROM truth t WHERE t.session_id = p.session_id AND abs(t.mid - p.t) <= 6)
         THEN 'duplicate' ELSE 'outside' END
  FROM pred p LEFT JOIN matches m ON m.session_id = p.session_id AND m.prediction_id = p.id
)"""


@register(
    "match_events",
    MATCHING + "\n--\nSELECT * FROM matches",
    "annotation_midpoint_s annotation_half_width_s signed_error_s absolute_error_s "
    "confirmation_delay_s",
)
def match_events(v: Views):
    return matches(v)


@register("match_classes", MATCHING + "\n--\nSELECT * FROM classes")
def match_classes(v: Views):
    return scoring.match_classes(truth_ev(v), pred_ev(v), matches(v), v.axis, MATCH_WINDOW)


METRICS_CTE = """, c AS (
  SELECT session_id, count(*) FILTER (WHERE side = 'truth') AS truth_count,
         count(*) FILTER (WHERE side = 'prediction') AS prediction_count,
         count(*) FILTER (WHERE side = 'truth' AND class = 'matched') AS matched_count,
         count(*) FILTER (WHERE class = 'missed') AS missed_count,
         count(*) FILTER (WHERE class = 'duplicate') AS duplicate_count,
         count(*) FILTER (WHERE class = 'outside') AS outside_count
  FROM classes GROUP BY session_id
), e AS (
  SELECT session_id, quantile_cont(absolute_error_s, 0.5) AS median_error_s,
         quantile_cont(absolute_error_s, 0.95) AS p95_error_s FROM matches GROUP BY session_id
), metrics AS (
  SELECT *, CASE WHEN prediction_count > 0 AND truth_count > 0 THEN matched_count / prediction_count END
           AS precision, CASE WHEN truth_count > 0 THEN matched_count / truth_count END AS recall,
         CASE WHEN truth_count > 0 THEN 'available' ELSE 'not_evaluated' END AS status
  FROM c LEFT JOIN e USING (session_id)
)"""


@register(
    "match_metrics",
    MATCHING + METRICS_CTE + "\n--\nSELECT * FROM metrics",
    "median_error_s p95_error_s precision recall",
)
def match_metrics(v: Views):
    # Used twice; matching costs more than keeping its result.
    found = materialize(matches(v))
    classes = scoring.match_classes(truth_ev(v), pred_ev(v), found, v.axis, MATCH_WINDOW)
    return scoring.match_metrics(classes, found, KEY)


ELIGIBLE = SIG + """, p AS (
  SELECT session_id, event_id AS id, ['brake_onset', 'brake_release', 'throttle_reapplication',
           'throttle_release', 'first_visible_brake', NULL][event_id % 6 + 1] AS event_type,
         CASE WHEN event_id % 8 = 0 THEN FALSE END AS eligible,
         event_id % 3 <> 0 AS reviewed, CASE WHEN event_id % 10 = 1 THEN 2.0 ELSE 5.0 END AS threshold
  FROM sig WHERE event_type = 'purchase'
), x AS (
  SELECT *, CASE WHEN event_type IS NULL OR event_type = 'first_visible_brake'
                      OR eligible IS NOT DISTINCT FROM FALSE
                 THEN 'no_reviewed_applicable_crossing_semantics'
            WHEN event_type LIKE '%release' AND NOT (reviewed AND threshold = 5)
                 THEN 'release_marker_does_not_establish_falling_threshold' END AS excluded_because
  FROM p
)"""


def eligibility(v: Views):
    e = F.col("event_id")
    names = F.array(*[F.lit(n) for n in (*scoring.PEDAL_TYPES, "first_visible_brake", None)])
    rows = v.sig.filter(F.col("event_type") == "purchase").select(
        "session_id", e.alias("id"), F.lit("pedal_event").alias("kind"),
        F.get(names, (e % 6).cast("int")).alias("event_type"),
        F.when(e % 8 == 0, F.lit(False)).alias("eligible"),
        F.lit(None).cast("string").alias("exclusion_reason"),
        (e % 3 != 0).alias("threshold_reviewed"),
        F.when(e % 10 == 1, 2.0).otherwise(5.0).alias("threshold_pct"),
    )
    return scoring.truth_eligibility(rows, 5.0)


@register(
    "truth_eligibility",
    ELIGIBLE + """
--
SELECT session_id, id, event_type, excluded_because, excluded_because IS NULL AS included FROM x""",
)
def truth_eligibility(v: Views):
    rows = eligibility(v)
    return rows.select("session_id", "id", "event_type", "excluded_because", "included")


