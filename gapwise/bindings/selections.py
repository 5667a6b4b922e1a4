"""Queries on filters, selections and visibility."""

from pyspark.sql import functions as F

from gapwise.bindings.registry import register
from gapwise.bindings.views import BOUNDARIES, LAPS, OBS, SIG, SPANS_CTE, Views
from gapwise.operators import selection


@register(
    "select_rows",
    LAPS + """
--
SELECT session_id, frame, lap_number, time_s FROM laps
WHERE lap_number IN (0, 2) AND frame BETWEEN 3 AND 60""",
    "time_s",
)
def select_rows(v: Views):
    rows = selection.select_rows(v.laps, [0, 2], 3, 60)
    return rows.select("session_id", "frame", "lap_number", "time_s")


@register(
    "select_laps",
    LAPS + """, times AS (
  SELECT session_id, lap_number, max(time_s) - min(time_s) AS lap_time FROM laps GROUP BY ALL
)
--
SELECT session_id, lap_number, frame, speed, lap_time FROM laps
JOIN times USING (session_id, lap_number)
WHERE (session_id, lap_number) IN ((1, 0), (1, 1), (2, 1), (3, 2))""",
    "speed lap_time",
)
def select_laps(v: Views):
    span = F.max("time_s") - F.min("time_s")
    times = v.laps.groupBy("session_id", "lap_number").agg(span.alias("lap_time"))
    rows = selection.select_laps(v.laps, [(1, 0), (1, 1), (2, 1), (3, 2)], times)
    return rows.select("session_id", "lap_number", "frame", "speed", "lap_time")


BOUNDED = BOUNDARIES + """, bounded AS (
  SELECT session_id, to_lap AS lap_number, frame AS start_frame, nf AS end_frame,
         time_s AS start_time_s, nt AS end_time_s
  FROM (SELECT *, lead(frame) OVER w AS nf, lead(time_s) OVER w AS nt, lead(to_lap) OVER w AS nl,
               count(*) OVER (PARTITION BY session_id, to_lap) AS starts
        FROM boundaries WINDOW w AS (PARTITION BY session_id ORDER BY frame))
  WHERE starts = 1 AND nl = to_lap + 1 AND nf > frame
)"""


def bounded(v: Views):
    return selection.bounded_laps(v.boundaries, v.axis)


@register(
    "bounded_laps",
    BOUNDED + "\n--\nSELECT * FROM bounded",
    "start_time_s end_time_s",
)
def bounded_laps(v: Views):
    return bounded(v)


@register(
    "frames_in_window",
    BOUNDED + """
--
SELECT session_id, lap_number,
       CAST(ceil((start_time_s + 12.0) * 0.1 - 1e-9) AS BIGINT) AS first_frame,
       CAST(ceil((start_time_s + 48.0) * 0.1 - 1e-9) AS BIGINT) AS end_frame_exclusive,
       start_frame <= ceil((start_time_s + 12.0) * 0.1 - 1e-9)
         AND ceil((start_time_s + 12.0) * 0.1 - 1e-9) < ceil((start_time_s + 48.0) * 0.1 - 1e-9)
         AND ceil((start_time_s + 48.0) * 0.1 - 1e-9) <= end_frame AS valid_window
FROM bounded""",
)
def frames_in_window(v: Views):
    rows = selection.frames_in_window(bounded(v), 12.0, 48.0, 0.1)
    return rows.select("session_id", "lap_number", "first_frame", "end_frame_exclusive",
                       "valid_window")


@register(
    "frame_sequence",
    BOUNDED + """, b AS (
  SELECT *, CAST(ceil(start_time_s * 0.1 - 1e-9) AS BIGINT) AS a,
         CAST(floor(end_time_s * 0.1 + 1e-9) AS BIGINT) AS z FROM bounded
)
--
SELECT session_id, lap_number, unnest(range(a, z + 1, 3)) AS frame FROM b WHERE a <= z""",
)
def frame_sequence(v: Views):
    rows = selection.frame_sequence(bounded(v), "start_time_s", "end_time_s", 30.0, 0.1)
    return rows.select("session_id", "lap_number", "frame")


@register(
    "evenly_spaced",
    SIG + """, n AS (
  SELECT session_id, frame, row_number() OVER (PARTITION BY session_id ORDER BY frame) - 1 AS i,
         count(*) OVER (PARTITION BY session_id) AS n FROM sig
), p AS (
  SELECT DISTINCT session_id, n, CASE WHEN j = least(n, 10) - 1 AND j > 0 THEN n - 1
         ELSE CAST(floor(j * ((n - 1) / greatest(least(n, 10) - 1, 1))) AS BIGINT) END AS i
  FROM n, range(10) t(j) WHERE j < least(n, 10)
)
--
SELECT n.session_id, n.frame FROM n JOIN p ON n.session_id = p.session_id AND n.i = p.i""",
)
def evenly_spaced(v: Views):
    return selection.evenly_spaced(v.sig, v.axis, 10).select("session_id", "frame")


@register(
    "every_step",
    SIG.replace("WITH sig0", "WITH RECURSIVE sig0") + """, n AS (
  SELECT session_id, frame, time_s, row_number() OVER (PARTITION BY session_id ORDER BY frame) AS i
  FROM sig
), walk AS (
  SELECT session_id, frame, i, CASE WHEN time_s >= 0 THEN 1 ELSE 0 END AS picks,
         time_s >= 0 AS picked FROM n WHERE i = 1
  UNION ALL
  SELECT n.session_id, n.frame, n.i,
         w.picks + CASE WHEN n.time_s >= w.picks * 24.0 THEN 1 ELSE 0 END,
         n.time_s >= w.picks * 24.0
  FROM walk w JOIN n ON n.session_id = w.session_id AND n.i = w.i + 1
)
--
SELECT session_id, frame FROM walk WHERE picked""",
)
def every_step(v: Views):
    return selection.every_step(v.sig, v.axis, 24.0).select("session_id", "frame")


@register(
    "list_sessions",
    LAPS + """
--
SELECT session_id, count(*) AS frames, count(DISTINCT lap_number) AS laps,
       max(time_s) AS last_time_s
FROM laps GROUP BY session_id""",
    "last_time_s",
)
def list_sessions(v: Views):
    return selection.list_sessions(v.laps)


@register(
    "list_laps",
    LAPS + """
--
SELECT session_id, lap_number, count(*) AS frames, min(frame) AS start_frame,
       max(frame) AS end_frame
FROM laps GROUP BY session_id, lap_number""",
)
def list_laps(v: Views):
    return selection.list_laps(v.laps)


GATED = OBS + SPANS_CTE + """, g AS (
  SELECT o.*, s.state FROM obs o LEFT JOIN spans s
    ON o.session_id = s.session_id AND o.field = s.field
   AND s.start_s <= o.time_s AND o.time_s < s.end_s
)"""


@register(
    "gate_visibility",
    GATED + """
--
SELECT session_id, frame, field, CASE WHEN state IS NOT NULL THEN value END AS value,
       CASE WHEN state IS NOT NULL THEN quality ELSE 'missing' END AS quality,
       CASE WHEN state IS NOT NULL THEN '' ELSE 'hud_visibility_unverified' END AS reasons
FROM g""",
    "value",
)
def gate_visibility(v: Views):
    rows = selection.gate_visibility(v.obs, v.spans, v.axis)
    return rows.select("session_id", "frame", "field", "value", "quality", "reasons")


@register(
    "gate_visibility_state",
    GATED + """
--
SELECT session_id, frame, field,
       CASE WHEN coalesce(state, 'unknown') <> 'absent' THEN value END AS value,
       CASE WHEN coalesce(state, 'unknown') <> 'absent' THEN quality ELSE 'missing' END AS quality,
       CASE coalesce(state, 'unknown') WHEN 'visible' THEN '' WHEN 'absent' THEN 'speed_hud_absent'
            ELSE 'speed_hud_unverified' END AS reasons
FROM g""",
    "value",
)
def gate_visibility_state(v: Views):
    rows = selection.gate_visibility(
        v.obs, v.spans, v.axis, allow_unreviewed=True, use_state=True
    )
    return rows.select("session_id", "frame", "field", "value", "quality", "reasons")
