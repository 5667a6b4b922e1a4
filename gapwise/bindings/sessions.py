"""Whole-session jobs: evaluation against reviews, and progress from label readings to its diagnosis."""


from pyspark.sql import functions as F

from gapwise.bindings.distance import JUDGED, LAP_DIST, LENGTH, ODO, WALK
from gapwise.bindings.integrity import annotation_frames
from gapwise.bindings.registry import register
from gapwise.bindings.summaries import ELIGIBLE, MATCHING, METRICS_CTE, eligibility
from gapwise.bindings.views import (
    BOUNDARIES, BRAKE, CROSSING, FILL_GAP, LABEL_COUNT, LAPS, MATCH_WINDOW, SETTINGS, SIG, SPANS_CTE, THROTTLE, Views,
)
from gapwise.operators import fusion, labels, runs, scoring
from gapwise.plans import evaluation, jobs

KEY = ("session_id",)

# --- progress ---------------------------------------------------------------------------

FUSION = fusion.FusionSettings(visual_gain=0.35, short_visual_gap=24.0, unavailable_uncertainty=0.5)
ANCHORS = fusion.AnchorSettings(unavailable_uncertainty=0.01)

CONFIRMED = """, boundaries AS (
  SELECT session_id, frame, time_s, before AS from_lap, now AS to_lap
  FROM walk WHERE before IS NOT NULL AND now <> before
)"""

# Confirmed labels, distances between their boundaries, one length per session, and the fusion row by row.
DIAGNOSED = (
    WALK + LAPS.removeprefix(SIG) + CONFIRMED + LAP_DIST.removeprefix(BOUNDARIES)
    + JUDGED.removeprefix(LAP_DIST).replace("session_id % 10 AS track", "session_id AS track")
    + f""", length AS (
  SELECT s.session_id, coalesce(m, {LENGTH}) AS len
  FROM (SELECT DISTINCT session_id FROM sig) s LEFT JOIN (
    SELECT track AS session_id, quantile_cont(distance_m, 0.5) AS m FROM laps_judged WHERE accepted GROUP BY track
  ) USING (session_id)
), fin AS (
  SELECT o.session_id, o.frame, o.time_s, o.distance_m, o.delta_distance_m AS dd, o.odometry_uncertainty AS ou,
         o.odometry_source AS os, b.frame IS NOT NULL AS bd, len, w.now AS lap,
         row_number() OVER (PARTITION BY o.session_id ORDER BY o.frame) AS i
  FROM odo o JOIN length USING (session_id) JOIN walk w ON w.session_id = o.session_id AND w.frame = o.frame
  LEFT JOIN boundaries b ON o.session_id = b.session_id AND o.frame = b.frame
), fw AS (
  SELECT session_id, frame, i, time_s, bd, lap, FALSE AS anchored, 0.0::DOUBLE AS s, time_s AS t, NULL::DOUBLE AS vt,
         ou AS u, 0.0::DOUBLE AS d0, 0.0::DOUBLE AS u0, 'missing' AS source, NULL::DOUBLE AS so
  FROM fin WHERE i = 1
  UNION ALL
  SELECT session_id, frame, i, time_s, bd, lap, anchored OR bd, CASE WHEN bd THEN 0.0 WHEN NOT anchored THEN s ELSE pr END,
         time_s, CASE WHEN bd THEN time_s ELSE vt END,
         CASE WHEN bd THEN 0.01 WHEN NOT anchored THEN greatest(u, ou)
              ELSE least(1.0, CASE WHEN os = 'missing' OR time_s - vt > 24 THEN greatest(grow, 0.5) ELSE grow END) END,
         CASE WHEN bd THEN distance_m ELSE d0 END, CASE WHEN bd THEN ou ELSE u0 END,
         CASE WHEN bd THEN 'observed' WHEN NOT anchored THEN 'missing' WHEN os = 'interpolated' THEN 'interpolated'
              WHEN os = 'missing' THEN 'missing' ELSE 'predicted' END,
         CASE WHEN bd THEN 0.0 WHEN anchored THEN least(1.0, greatest(0.0, distance_m - d0) / len) END
  FROM (SELECT *, least(1.0, base + greatest(0.0, time_s - t) * 0.5 / 24) AS grow
        FROM (SELECT f.*, w.anchored, w.s, w.t, w.vt, w.u, w.d0, w.u0,
                     least(1.0, greatest(0.0, w.s + coalesce(f.dd, 0) / f.len)) AS pr,
                     greatest(w.u, greatest(0.0, f.ou - w.u0)) AS base
              FROM fw w JOIN fin f ON f.session_id = w.session_id AND f.i = w.i + 1))
), progress AS (
  SELECT session_id, frame, time_s, bd AS is_boundary, lap AS lap_number, so AS s_odometry,
         CASE WHEN anchored AND (bd OR u < 0.5) THEN s END AS s_fused,
         CASE WHEN anchored AND NOT bd AND u >= 0.5 THEN 'missing' ELSE source END AS s_source, u AS s_uncertainty
  FROM fw
)"""
)



def _diagnosed(v: Views):
    return jobs.diagnosed_progress(
        v.sig, None, None, v.axis, label="raw_lap", count=LABEL_COUNT, speed="value", quality="q",
        max_gap=FILL_GAP, max_missing=0.8, max_deviation=0.4, max_distance=1.0, fusion_settings=FUSION,
        selection=fusion.SelectionSettings(), anchors=ANCHORS,
        default_length=v.sessions.select("session_id", F.lit(LENGTH).alias("length")),
    )


@register(
    "progress_by_odometry",
    DIAGNOSED + """
--
SELECT session_id, frame, lap_number, is_boundary, s_fused, s_odometry, s_source, least(1.0, s_uncertainty) AS s_uncertainty
FROM progress""",
    "s_fused s_odometry s_uncertainty",
)
def progress_by_odometry(v: Views):
    """Labels confirmed, length calibrated by their boundaries, progress by odometry alone."""
    rows = _diagnosed(v)["progress"]
    return rows.select("session_id", "frame", "lap_number", "is_boundary", "s_fused", "s_odometry", "s_source", "s_uncertainty")


@register(
    "progress_diagnosis",
    DIAGNOSED + """, p AS (
  SELECT *, lag(s_fused) OVER w AS ps, lag(time_s) OVER w AS pt, row_number() OVER w AS i
  FROM progress WINDOW w AS (PARTITION BY session_id ORDER BY frame)
), curve AS (
  SELECT session_id, lap_number AS lap, s_odometry AS x, avg(s_fused) AS y
  FROM progress WHERE s_fused IS NOT NULL AND s_odometry IS NOT NULL AND lap_number IS NOT NULL GROUP BY ALL
), whole AS (
  SELECT session_id, lap FROM curve GROUP BY ALL HAVING min(x) <= 0.01 AND max(x) >= 0.99
), cv AS (
  SELECT curve.*, lag(x) OVER w AS px, lag(y) OVER w AS py FROM curve SEMI JOIN whole USING (session_id, lap)
  WINDOW w AS (PARTITION BY session_id, lap ORDER BY x)
), val AS (
  SELECT session_id, k, CASE WHEN k / 100.0::DOUBLE = x THEN y
                        ELSE py + (k / 100.0::DOUBLE - px) / (x - px) * (y - py) END AS h
  FROM cv, range(1, 100) t(k)
  WHERE k / 100.0::DOUBLE = x OR (k / 100.0::DOUBLE > px AND k / 100.0::DOUBLE < x)
), spread AS (
  SELECT session_id, max(d) AS max_checkpoint_spread, count(*) AS comparable_checkpoint_count
  FROM (SELECT session_id, k, max(h) - min(h) AS d FROM val GROUP BY ALL HAVING count(*) >= 2) GROUP BY session_id
)
--
SELECT p.session_id, count(*) AS frame_count, count(*) FILTER (WHERE is_boundary) AS confirmed_boundary_count,
       count(*) FILTER (WHERE NOT is_boundary AND s_fused >= 0.999
         AND (s_odometry IS NULL OR s_odometry < 0.99)) AS premature_completion_count,
       count(*) FILTER (WHERE NOT is_boundary AND ps >= 0.9 AND s_fused <= 0.1) AS unconfirmed_reset_count,
       count(*) FILTER (WHERE NOT is_boundary AND
         abs((s_fused - ps + 0.5) - floor(s_fused - ps + 0.5) - 0.5) > 0.1) AS nonlocal_jump_count,
       coalesce(sum(CASE WHEN i > 1 AND ps IS NULL THEN greatest(0.0, time_s - pt) END), 0.0) AS unavailable_duration_s,
       count(*) FILTER (WHERE s_source = 'observed') AS source_observed,
       count(*) FILTER (WHERE s_source = 'fused') AS source_fused,
       count(*) FILTER (WHERE s_source = 'predicted') AS source_predicted,
       count(*) FILTER (WHERE s_source = 'interpolated') AS source_interpolated,
       count(*) FILTER (WHERE s_source = 'missing') AS source_missing,
       0 AS anchor_exact, 0 AS anchor_interpolated, 0 AS anchor_nearest,
       count(*) FILTER (WHERE is_boundary) AS anchor_missing,
       any_value(max_checkpoint_spread) AS max_checkpoint_spread,
       coalesce(any_value(comparable_checkpoint_count), 0) AS comparable_checkpoint_count
FROM p LEFT JOIN spread USING (session_id) GROUP BY p.session_id""",
    "unavailable_duration_s max_checkpoint_spread",
)
def progress_diagnosis(v: Views):
    """One row per session about the progress that label readings and odometry give."""
    return _diagnosed(v)["diagnosis"]


# --- evaluation ---------------------------------------------------------------------------

EVALUATION = evaluation.EvaluationSettings(
    mae={"brake": 2.0, "throttle": 2.0}, coverage=0.75, window=MATCH_WINDOW, max_error=4.0
)
TYPES = (*scoring.PEDAL_TYPES, evaluation.LAP)


def _crossings_sql(value: str, ok: str, name: str) -> str:
    return f"""
  SELECT session_id, '{name}-' || frame AS id, '{name} ' || CASE WHEN pv <= 50 THEN 'onset' ELSE 'release' END AS kind,
         frame, time_s
  FROM (SELECT *, {value} AS x, {ok} AS ok, lag({value}) OVER w AS pv, lag({ok}) OVER w AS pok, lag(frame) OVER w AS pf,
               lag(time_s) OVER w AS pt FROM sig WINDOW w AS (PARTITION BY session_id ORDER BY frame))
  WHERE ok AND pok AND frame = pf + 1 AND time_s - pt > 0 AND time_s - pt <= 24
    AND ((pv <= 50 AND x > 50) OR (pv > 50 AND x <= 50))"""


_TYPE_NO = "list_position([" + ", ".join(f"'{t}'" for t in TYPES) + "], type)"
_KINDS = "MAP {" + ", ".join(f"'{f} {d}': '{n}'" for n, (f, d) in scoring.PEDAL_TYPES.items()) + "}"

# One matching of all types: a session's type is its own key, ten times the session and the type's number.
_EVENTS = (
    WALK + LAPS.removeprefix(SIG) + BOUNDARIES.removeprefix(LAPS) + ELIGIBLE.removeprefix(SIG).replace(", p AS (", ", pe AS (").replace("FROM p\n", "FROM pe\n")
    + f""", passages AS (
  SELECT x.session_id, x.event_type AS type, x.id::VARCHAR AS id, time_s AS lo_s, time_s + 0.5 AS hi_s
  FROM x JOIN sig ON sig.session_id = x.session_id AND sig.event_id = x.id WHERE excluded_because IS NULL
  UNION ALL SELECT session_id, '{evaluation.LAP}', frame::VARCHAR, time_s, time_s FROM boundaries
), crossings AS ({_crossings_sql("v", "(q = 'observed' AND v IS NOT NULL)", "brake")}
  UNION ALL {_crossings_sql("k", "(k IS NOT NULL)", "throttle")}
), told AS (
  SELECT session_id, {_KINDS}[kind] AS type, id, time_s FROM crossings
  UNION ALL SELECT session_id, '{evaluation.LAP}', frame::VARCHAR, first_t FROM walk
  WHERE before IS NOT NULL AND now <> before AND first_t IS NOT NULL
), truth AS (
  SELECT session_id * 10 + {_TYPE_NO} AS session_id, id, (lo_s + hi_s) / 2 AS mid, lo_s, hi_s,
         row_number() OVER (PARTITION BY session_id, type ORDER BY (lo_s + hi_s) / 2, id) AS i
  FROM passages
), pred AS (
  SELECT session_id, id, t, row_number() OVER (PARTITION BY session_id ORDER BY t, id) AS j FROM (
    SELECT session_id * 10 + {_TYPE_NO} AS session_id, id, time_s AS t FROM told)
  q WHERE session_id % 10 = {len(TYPES)}
     OR EXISTS (FROM truth t WHERE t.session_id = q.session_id AND abs(t.mid - q.t) <= 6)
), """
    + MATCHING[MATCHING.index("p AS (\n  SELECT session_id, list(t") :]
    + METRICS_CTE
)

_FRESH = """, read AS (
  SELECT session_id, frame, time_s, 'brake' AS field, v AS value, q = 'observed' AND v IS NOT NULL AS fresh FROM sig
  UNION ALL SELECT session_id, frame, time_s, 'throttle', k, k IS NOT NULL FROM sig
)"""

CHECKS = (
    _EVENTS + SPANS_CTE + _FRESH + """, labelled AS (
  SELECT session_id, frame, 'brake' AS field, CASE WHEN event_id % 22 = 0 THEN 130.0 ELSE v END AS truth, event_id % 9 <> 0 AS visible
  FROM sig WHERE event_type IN ('purchase', 'click')
  UNION ALL SELECT session_id, frame, 'throttle', k, TRUE FROM sig WHERE event_type IN ('purchase', 'click')
), compared AS (
  SELECT l.*, r.value AS prediction FROM labelled l
  LEFT JOIN read r ON r.session_id = l.session_id AND r.frame = l.frame AND r.field = l.field AND r.fresh
), fields AS (
  SELECT session_id, field, count(*) FILTER (WHERE visible AND truth IS NOT NULL) AS expected,
         count(prediction) FILTER (WHERE visible AND truth IS NOT NULL) AS measured,
         avg(abs(truth - prediction)) FILTER (WHERE visible AND truth IS NOT NULL) AS mae,
         count(prediction) FILTER (WHERE NOT visible) AS wrong
  FROM compared GROUP BY ALL
), cont AS (
  SELECT f.session_id, f.field, count(DISTINCT c.time_s) FILTER (WHERE s.start_s IS NOT NULL) AS expected,
         count(DISTINCT c.time_s) FILTER (WHERE s.start_s IS NOT NULL AND r.fresh) AS measured
  FROM (SELECT DISTINCT session_id, field FROM read) f JOIN sig0 c USING (session_id)
  LEFT JOIN spans s ON c.session_id = s.session_id AND s.field = f.field AND s.state = 'visible'
   AND s.start_s <= c.time_s AND c.time_s < s.end_s
  LEFT JOIN read r ON r.session_id = c.session_id AND r.frame = c.frame AND r.field = f.field
  GROUP BY f.session_id, f.field
), seen AS (
  SELECT session_id, count(*) AS observable_count FROM (
    SELECT t.session_id, t.id FROM truth t JOIN sig0 f ON f.session_id = t.session_id // 10
     AND f.time_s BETWEEN t.mid - 6 AND t.mid + 6
    LEFT JOIN read r ON r.session_id = f.session_id AND r.frame = f.frame
     AND r.field = CASE WHEN t.session_id % 10 <= 2 THEN 'brake' ELSE 'throttle' END
    WHERE t.session_id % 10 < """ + str(len(TYPES)) + """ GROUP BY t.session_id, t.id
    HAVING count(DISTINCT f.time_s) >= 2 AND bool_and(coalesce(r.fresh, FALSE))
  ) GROUP BY session_id
), checks AS (
  SELECT session_id, 'accuracy' AS part, field AS name,
         CASE WHEN wrong > 0 OR mae > 2 THEN 'fail' WHEN mae IS NULL THEN 'not_evaluated' ELSE 'pass' END AS status,
         measured, expected, wrong AS "false" FROM fields
  UNION ALL SELECT session_id, 'coverage', field, CASE WHEN expected = 0 THEN 'not_evaluated'
         WHEN measured / expected < 0.75 THEN 'fail' ELSE 'pass' END, measured, expected, 0 FROM fields
  UNION ALL SELECT session_id, 'continuous', field, CASE WHEN expected = 0 THEN 'not_evaluated'
         WHEN measured / expected < 0.75 THEN 'fail' ELSE 'pass' END, measured, expected, 0 FROM cont
  UNION ALL SELECT m.session_id // 10, CASE WHEN m.session_id % 10 = """ + str(len(TYPES)) + """ THEN 'laps' ELSE 'pedal' END,
         [""" + ", ".join(f"'{t}'" for t in TYPES) + """][m.session_id % 10],
         CASE WHEN m.session_id % 10 = """ + str(len(TYPES)) + """ THEN
           CASE WHEN truth_count = 0 THEN 'not_evaluated'
                WHEN missed_count > 0 OR coalesce(p95_error_s > 4, FALSE) THEN 'fail'
                WHEN m.session_id // 10 % 2 <> 0 THEN 'not_evaluated'
                WHEN duplicate_count + outside_count > 0 THEN 'fail' ELSE 'pass' END
         ELSE CASE WHEN coalesce(p95_error_s > 4, FALSE) THEN 'fail'
                WHEN truth_count = 0 OR coalesce(observable_count, 0) < truth_count THEN 'not_evaluated'
                WHEN missed_count > 0 THEN 'fail' ELSE 'pass' END END,
         matched_count, truth_count,
         CASE WHEN m.session_id % 10 = """ + str(len(TYPES)) + """ THEN duplicate_count + outside_count ELSE 0 END
  FROM metrics m LEFT JOIN seen USING (session_id)
  UNION ALL SELECT c.session_id, 'timebase', 'alignment', CASE WHEN count(s.frame) = count(*) THEN 'pass' ELSE 'fail' END,
         count(s.frame), count(*), 0
  FROM sig0 c LEFT JOIN sig s ON s.session_id = c.session_id AND s.frame = c.frame GROUP BY c.session_id
)"""
)



def _evaluated(v: Views):
    v, e = v.kept(), F.col("event_id")

    def fields(brake, throttle, **more):
        def one(name, value, extra):
            return F.struct(F.lit(name).alias("field"), value, *(x.alias(n) for n, x in extra.items()))

        first = {n: x[0] for n, x in more.items()}
        second = {n: x[1] for n, x in more.items()}
        return F.inline(F.array(one("brake", brake, first), one("throttle", throttle, second)))

    shown = annotation_frames(v).select(
        "session_id", "frame",
        fields(F.col("brake_pct").alias("truth"), F.col("throttle_pct").alias("truth"), visible=(F.col("visibility")["brake"], F.lit(True))),
    )
    samples = v.sig.select(
        "session_id", "frame", "time_s",
        fields(F.col("v").cast("double").alias("value"), F.col("k").cast("double").alias("value"), fresh=(BRAKE.fresh(), THROTTLE.fresh())),
    )
    times = v.sig.select("session_id", e.alias("id"), F.col("time_s").alias("lo_s"), (F.col("time_s") + 0.5).alias("hi_s"))
    pedals = eligibility(v).filter("included").select("session_id", "id", F.col("event_type").alias("type")).join(times, ["session_id", "id"])
    laps = v.boundaries.select(
        "session_id", F.col("frame").alias("id"), F.lit(evaluation.LAP).alias("type"), F.col("time_s").alias("lo_s"), F.col("time_s").alias("hi_s")
    )
    passages = pedals.unionByName(laps).withColumn("id", F.col("id").cast("string"))
    found = [runs.threshold_crossings(v.sig, v.axis, c, CROSSING, SETTINGS.max_gap) for c in (BRAKE, THROTTLE)]
    bounds = labels.boundaries(labels.confirm_labels(v.sig, v.axis, "raw_lap", LABEL_COUNT), v.axis)
    transitions = bounds.filter(F.col("first_candidate_time_s").isNotNull()).select(
        "session_id", F.col("frame").cast("string").alias("id"), F.col("first_candidate_time_s").alias("time_s")
    )
    marks = v.sig.filter(F.col("event_type").isin("purchase", "error")).select(
        "session_id", F.concat(F.lit("l"), e % 3).alias("landmark_id"), e.alias("id"), F.col("frame").alias("frame_lo"), F.col("frame").alias("frame_hi")
    )
    return evaluation.evaluate_session(
        labels=shown, samples=samples, capture=v.sig0.select("session_id", "frame", "time_s"),
        spans=v.spans.filter("state = 'visible'"), passages=passages, crossings=found[0].unionByName(found[1]),
        transitions=transitions, landmarks=marks, positions=v.sig.select("session_id", "frame", "s", F.col("q").alias("s_quality")),
        complete_review=v.sessions.filter("session_id % 2 = 0"), axis=v.axis, settings=EVALUATION,
    )


@register("evaluate_session_checks", CHECKS + "\n--\nSELECT * FROM checks")
def evaluate_session_checks(v: Views):
    """Every check of every session, as one long table."""
    return _evaluated(v)["checks"]


def _part_sql(part: str) -> str:
    own = f"FILTER (WHERE part = '{part}'"
    return f"""CASE WHEN count(*) {own} AND status = 'fail') > 0 THEN 'fail'
       WHEN count(*) {own} AND status = 'not_evaluated') > 0 OR count(*) {own}) = 0 THEN 'not_evaluated'
       ELSE 'pass' END AS {part}_status"""


@register(
    "evaluate_session",
    CHECKS + """, lm AS (
  SELECT session_id, 'l' || event_id % 3 AS landmark_id, CASE WHEN q = 'observed' THEN s END AS s
  FROM sig WHERE event_type IN ('purchase', 'error')
), lo AS (
  SELECT *, s - lag(s) OVER (PARTITION BY session_id, landmark_id ORDER BY s) AS gap FROM lm WHERE s IS NOT NULL
), lr AS (
  SELECT session_id, landmark_id, count(*) AS n, 1 - greatest(coalesce(max(gap), 0), min(s) + 1 - max(s)) AS r
  FROM lo GROUP BY ALL HAVING count(*) >= 2
), marks AS (
  SELECT session_id, count(*) AS landmarks_available, max(r) AS landmark_range_s FROM lr GROUP BY session_id
), ranked AS (
  SELECT session_id, """ + ",\n       ".join(map(_part_sql, evaluation.PARTS)) + """,
       CASE WHEN count(*) FILTER (WHERE status = 'fail') > 0 THEN 'fail'
            WHEN count(*) FILTER (WHERE status <> 'pass') = 0 THEN 'pass' ELSE 'not_evaluated' END AS status,
       count(*) FILTER (WHERE status = 'fail') AS failed_checks,
       count(*) FILTER (WHERE status = 'not_evaluated') AS open_checks,
       coalesce(sum("false") FILTER (WHERE part = 'accuracy'), 0)::BIGINT AS false_observed_count
  FROM checks GROUP BY session_id
)
--
SELECT r.*, coalesce(landmarks_available, 0) AS landmarks_available, landmark_range_s
FROM ranked r LEFT JOIN marks USING (session_id)""",
    "landmark_range_s",
)
def evaluate_session(v: Views):
    """One row per session: the status of every part, and what stands in its way."""
    return _evaluated(v)["sessions"]
