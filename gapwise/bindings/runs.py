"""Queries on evidence runs, events and episodes."""

from pyspark.sql import functions as F

from gapwise.bindings.registry import register
from gapwise.bindings.views import (
    BRAKE, CROSSING, FRAME_TIME, GEAR, SETTINGS, SIG, THROTTLE, Views,
)
from gapwise.ordered import materialize
from gapwise.operators import episodes, runs

PREV = SIG + """, prev AS (
  SELECT *, (q = 'observed' AND v IS NOT NULL AND v BETWEEN 0 AND 100) AS ok,
         lag(frame) OVER w AS pf, lag(time_s) OVER w AS pt
  FROM sig WINDOW w AS (PARTITION BY session_id ORDER BY frame)
), brk AS (
  SELECT *, lag(ok) OVER w AS pok,
         coalesce(frame <> pf + 1 OR time_s - pt > 24 + 1e-12, FALSE) AS sampling_break
  FROM prev WINDOW w AS (PARTITION BY session_id ORDER BY frame)
), runs AS (
  SELECT *, last_value(CASE WHEN ok AND NOT (coalesce(pok, FALSE) AND NOT sampling_break)
                            THEN frame END IGNORE NULLS) OVER w AS run_start,
            last_value(CASE WHEN NOT ok AND NOT (coalesce(NOT pok, FALSE) AND NOT sampling_break)
                            THEN frame END IGNORE NULLS) OVER w AS gap_start
  FROM brk WINDOW w AS (PARTITION BY session_id ORDER BY frame)
)"""


@register(
    "evidence_runs",
    PREV + """
--
SELECT session_id, run_start, max(frame) AS end_frame, min(time_s) AS start_time_s,
       max(time_s) AS end_time_s, count(*) AS samples, 'brake' AS field,
       'brake-run-' || run_start AS run_id
FROM runs WHERE ok GROUP BY session_id, run_start""",
    "start_time_s end_time_s",
)
def evidence_runs(v: Views):
    return runs.evidence_runs(v.sig, v.axis, BRAKE, SETTINGS.max_gap)


@register(
    "evidence_gaps",
    PREV + """
--
SELECT session_id, 'brake' AS field, 'sampling_gap' AS kind, pf AS start_frame,
       frame AS end_frame, pt AS start_time_s, time_s AS end_time_s, '' AS reasons
FROM runs WHERE sampling_break
UNION ALL
SELECT session_id, 'brake', 'invalid_samples', min(frame), max(frame) + 1, min(time_s),
       max(time_s) + 1.0, 'not_fresh_or_out_of_range'
FROM runs WHERE NOT ok GROUP BY session_id, gap_start""",
    "start_time_s end_time_s",
)
def evidence_gaps(v: Views):
    return runs.evidence_gaps(v.sig, v.axis, BRAKE, SETTINGS.max_gap, FRAME_TIME)


@register(
    "missing_intervals",
    SIG + """, f AS (
  SELECT *, (q = 'observed' AND v IS NOT NULL) AS ok FROM sig
), g AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY frame)
          - row_number() OVER (PARTITION BY session_id, ok ORDER BY frame) AS island FROM f
)
--
SELECT session_id, 'brake' AS field, min(frame) AS start_frame,
       max(frame) + 1 AS end_frame_exclusive, min(time_s) AS start_time_s,
       max(time_s) + 1.0 AS end_time_s, count(*) AS frames
FROM g WHERE NOT ok GROUP BY session_id, island""",
    "start_time_s end_time_s",
)
def missing_intervals(v: Views):
    return runs.missing_intervals(v.sig, v.axis, BRAKE, FRAME_TIME)


def events_sql(value: str, ok: str, name: str, frame_jump: bool) -> str:
    """Set form of the hysteresis rule; leaves a table ``<name>_events``."""
    jump = "OR frame <> lag(frame) OVER w + 1" if frame_jump else ""
    p = name
    return f""", {p}_a AS (
  SELECT *, {value} AS x, ({ok}) AS okk FROM sig
), {p}_b AS (
  SELECT *, okk AND (NOT coalesce(lag(okk) OVER w, FALSE) OR time_s - lag(time_s) OVER w <= 0
             OR time_s - lag(time_s) OVER w > 24 + 1e-12 {jump}) AS new_run,
         CASE WHEN NOT okk THEN NULL WHEN x >= 60 THEN 'H' WHEN x <= 30 THEN 'L' ELSE 'M' END AS lab,
         lag(time_s) OVER w AS before_s
  FROM {p}_a WINDOW w AS (PARTITION BY session_id ORDER BY frame)
), {p}_c AS (
  SELECT *, sum(new_run::INT) OVER w AS run_no,
         sum((okk AND (new_run OR lab IS DISTINCT FROM plab))::INT) OVER w AS isl_no
  FROM (SELECT *, lag(lab) OVER (PARTITION BY session_id ORDER BY frame) AS plab FROM {p}_b)
  WINDOW w AS (PARTITION BY session_id ORDER BY frame)
), {p}_d AS (
  SELECT session_id, run_no, isl_no, lab, min(frame) AS frame, min(time_s) AS time_s,
         arg_min(x, frame) AS val, arg_min(before_s, frame) AS before_s,
         min(frame) FILTER (WHERE time_s - t0 + 1e-12 >= 6) AS cframe,
         min(time_s) FILTER (WHERE time_s - t0 + 1e-12 >= 6) AS ctime
  FROM (SELECT *, min(time_s) OVER (PARTITION BY session_id, isl_no) AS t0 FROM {p}_c WHERE okk)
  WHERE lab IN ('H', 'L') GROUP BY session_id, run_no, isl_no, lab
), {p}_e AS (
  SELECT *, row_number() OVER (PARTITION BY session_id, run_no ORDER BY isl_no) = 1 AS first_in_run
  FROM {p}_d
), {p}_f AS (
  SELECT *, lag(lab) OVER (PARTITION BY session_id, run_no ORDER BY isl_no) AS qlab
  FROM {p}_e WHERE first_in_run OR cframe IS NOT NULL
), {p}_events AS (
  SELECT session_id,
         '{name}' || CASE WHEN first_in_run THEN '_active_unbounded' WHEN lab = 'H' THEN '_on'
                          ELSE '_off' END AS type,
         frame, time_s,
         CASE WHEN first_in_run THEN frame ELSE cframe END AS confirmed_frame,
         CASE WHEN first_in_run THEN time_s ELSE ctime END AS confirmed_at_s,
         CASE WHEN NOT first_in_run THEN before_s END AS previous_evidence_time_s,
         val AS value
  FROM {p}_f WHERE CASE WHEN first_in_run THEN lab = 'H' ELSE lab <> qlab END
)"""


BRAKE_OK = "q = 'observed' AND v IS NOT NULL AND v BETWEEN 0 AND 100"
THROTTLE_OK = "k IS NOT NULL AND k BETWEEN 0 AND 100"
EVENT_COLUMNS = """session_id, type || '-' || frame AS id, type, '{field}' AS field, frame, time_s,
       confirmed_frame, confirmed_at_s, previous_evidence_time_s, value,
       'candidate' AS status, '' AS reasons"""


@register(
    "hysteresis_events",
    SIG + events_sql("v", BRAKE_OK, "brake", False) + events_sql("k", THROTTLE_OK, "throttle", False)
    + "\n--\nSELECT " + EVENT_COLUMNS.format(field="brake") + " FROM brake_events UNION ALL SELECT "
    + EVENT_COLUMNS.format(field="throttle") + " FROM throttle_events",
    "time_s confirmed_at_s previous_evidence_time_s value",
)
def hysteresis_events(v: Views):
    return runs.hysteresis_events(v.sig, v.axis, [BRAKE, THROTTLE], SETTINGS)


@register(
    "change_events",
    SIG + """, p AS (
  SELECT *, lag(gear) OVER w AS pg, lag(time_s) OVER w AS pt
  FROM sig WINDOW w AS (PARTITION BY session_id ORDER BY frame)
)
--
SELECT session_id, 'gear_change-' || frame AS id, 'gear_change' AS type, 'gear' AS field, frame,
       time_s, frame AS confirmed_frame, time_s AS confirmed_at_s,
       pt AS previous_evidence_time_s, CAST(gear AS DOUBLE) AS value, 'candidate' AS status,
       '' AS reasons, CAST(pg AS DOUBLE) AS from_value, CAST(gear AS DOUBLE) AS to_value
FROM p WHERE gear <> pg AND time_s - pt > 0 AND time_s - pt <= 24 + 1e-12""",
    "time_s confirmed_at_s previous_evidence_time_s value from_value to_value",
)
def change_events(v: Views):
    return runs.change_events(v.sig, v.axis, GEAR, SETTINGS.max_gap)


CROSSINGS_CTE = """, crossings AS (
  SELECT session_id, 'brake-' || frame AS id, 'brake' AS field, frame, time_s,
         CASE WHEN pv <= 50 AND v > 50 THEN 'onset' WHEN pv > 50 AND v <= 50 THEN 'release'
              END AS direction, pt AS previous_time_s
  FROM (SELECT *, lag(v) OVER w AS pv, lag(q) OVER w AS pq, lag(frame) OVER w AS pf,
               lag(time_s) OVER w AS pt
        FROM sig WINDOW w AS (PARTITION BY session_id ORDER BY frame))
  WHERE q = 'observed' AND pq = 'observed' AND frame = pf + 1
    AND time_s - pt > 0 AND time_s - pt <= 24
    AND ((pv <= 50 AND v > 50) OR (pv > 50 AND v <= 50))
)"""


@register(
    "threshold_crossings",
    SIG + CROSSINGS_CTE + "\n--\nSELECT * FROM crossings",
    "time_s previous_time_s",
)
def threshold_crossings(v: Views):
    return runs.threshold_crossings(v.sig, v.axis, BRAKE, CROSSING, SETTINGS.max_gap)


def episodes_sql(value: str, ok: str, name: str) -> str:
    """Episodes from ``<name>_events`` by a range join; leaves ``<name>_episodes``."""
    p = name
    return events_sql(value, ok, name, True) + f""", {p}_r AS (
  SELECT *, last_value(CASE WHEN new_run THEN frame END IGNORE NULLS) OVER w AS run_start,
         lead(frame) OVER w IS NULL AS session_last, lag(frame) OVER w IS NULL AS session_first
  FROM {p}_c WINDOW w AS (PARTITION BY session_id ORDER BY frame)
), {p}_re AS (
  SELECT session_id, run_start, max(frame) AS run_end, bool_or(session_first) AS at_start,
         bool_or(session_last) AS at_end FROM {p}_r WHERE okk GROUP BY ALL
), {p}_p AS (
  SELECT e.*, r.run_start, r.run_end, r.at_start, r.at_end,
         lead(e.frame) OVER w AS nf, lead(e.time_s) OVER w AS nt, lead(e.value) OVER w AS nv
  FROM {p}_events e JOIN {p}_re r
    ON e.session_id = r.session_id AND e.frame BETWEEN r.run_start AND r.run_end
  WINDOW w AS (PARTITION BY e.session_id, r.run_start ORDER BY e.frame)
), {p}_s AS (
  SELECT p.session_id, p.frame AS start_frame, any_value(p.type) AS type,
         any_value(p.run_start) AS run_start, any_value(p.at_start) AS at_start,
         any_value(p.at_end) AS at_end, any_value(p.nf) AS nf, any_value(p.nt) AS nt,
         any_value(p.nv) AS nv, min(r.time_s) AS t0, max(r.time_s) AS t1, max(r.frame) AS f1,
         max(r.x) AS peak, count(*) AS n,
         arg_max(r.frame, (r.x, -r.frame)) AS fp, arg_max(r.time_s, (r.x, -r.frame)) AS fpt,
         arg_max(r.frame, (r.x, r.frame)) AS lp, arg_max(r.time_s, (r.x, r.frame)) AS lpt
  FROM {p}_p p JOIN {p}_r r ON p.session_id = r.session_id AND r.okk
   AND r.frame >= p.frame AND r.frame <= p.run_end AND (p.nf IS NULL OR r.frame < p.nf)
  WHERE p.type NOT LIKE '%\\_off' ESCAPE '\\' GROUP BY p.session_id, p.frame
), {p}_episodes AS (
  SELECT session_id, '{name}-episode-' || start_frame AS id, '{name}' AS field,
       '{name}-run-' || run_start AS run_id, start_frame, t0 AS start_time_s,
       coalesce(nf, f1) AS end_frame, coalesce(nt, t1) AS end_time_s,
       type = '{name}_active_unbounded' AS left_truncated, nf IS NULL AS right_truncated,
       concat_ws(';', CASE WHEN type = '{name}_active_unbounded' THEN
                   CASE WHEN at_start THEN 'session_start' ELSE 'evidence_gap' END END,
                 CASE WHEN nf IS NULL THEN
                   CASE WHEN at_end THEN 'session_end' ELSE 'evidence_gap' END END)
         AS truncation_reasons,
       '' AS reasons,
       CASE WHEN nf IS NOT NULL AND type <> '{name}_active_unbounded' THEN nt - t0 END AS duration_s,
       coalesce(nt, t1) - t0 AS observed_span_s, peak AS observed_peak,
       fp AS first_peak_frame, lp AS last_peak_frame,
       CASE WHEN type <> '{name}_active_unbounded' THEN fpt - t0 END AS time_to_first_peak_s,
       nt - lpt AS terminal_tail_s,
       CASE WHEN nt - lpt > 0 THEN (nv - peak) / (nt - lpt) END AS terminal_tail_slope,
       CAST(NULL AS DOUBLE) AS release_onset_s,
       n + (nf IS NOT NULL)::INT AS sample_count
  FROM {p}_s
)"""


EPISODES = SIG + episodes_sql("v", BRAKE_OK, "brake") + episodes_sql("k", THROTTLE_OK, "throttle")
EPISODE_DOUBLES = (
    "start_time_s end_time_s duration_s observed_span_s observed_peak time_to_first_peak_s "
    "terminal_tail_s terminal_tail_slope release_onset_s"
)


def both_episodes(v: Views):
    """Episodes of both pedals, in one pass."""
    return episodes.control_episodes(v.sig, v.axis, [BRAKE, THROTTLE], SETTINGS)


def kept_episodes(v: Views):
    """The episodes of each pedal, kept since they are few beside the rows they come from."""
    both = materialize(both_episodes(v))
    return [both.filter(F.col("field") == c.field) for c in (BRAKE, THROTTLE)]


@register(
    "control_episodes",
    EPISODES + "\n--\nSELECT * FROM brake_episodes UNION ALL SELECT * FROM throttle_episodes",
    EPISODE_DOUBLES,
)
def control_episodes(v: Views):
    return both_episodes(v)


@register(
    "resumptions",
    EPISODES + """
--
SELECT * FROM (
  SELECT session_id, field, id AS previous_episode_id, lead(id) OVER w AS next_episode_id,
         end_time_s AS off_time_s, lead(start_time_s) OVER w AS on_time_s,
         lead(start_time_s) OVER w - end_time_s AS inactive_interval_s
  FROM (SELECT * FROM brake_episodes UNION ALL SELECT * FROM throttle_episodes)
  WINDOW w AS (PARTITION BY session_id, run_id ORDER BY start_frame))
WHERE next_episode_id IS NOT NULL""",
    "off_time_s on_time_s inactive_interval_s",
)
def resumptions(v: Views):
    return episodes.resumptions(both_episodes(v), v.axis)


OVERLAPS_CTE = """, common AS (
  SELECT b.session_id, b.id AS first_episode_id, t.id AS second_episode_id,
       greatest(b.start_time_s, t.start_time_s) AS start_time_s,
       least(b.end_time_s, t.end_time_s) AS end_time_s,
       least(b.end_time_s, t.end_time_s) - greatest(b.start_time_s, t.start_time_s)
         AS observed_duration_s,
       b.left_truncated OR b.right_truncated OR t.left_truncated OR t.right_truncated
         AS boundary_limited
  FROM brake_episodes b JOIN throttle_episodes t ON b.session_id = t.session_id
  AND greatest(b.start_time_s, t.start_time_s) < least(b.end_time_s, t.end_time_s)
)"""


@register(
    "overlap_intervals",
    EPISODES + OVERLAPS_CTE + "\n--\nSELECT * FROM common",
    "start_time_s end_time_s observed_duration_s",
)
def overlap_intervals(v: Views):
    return episodes.overlap_intervals(*kept_episodes(v), ("session_id",))
