"""Queries on labels, admission, odometry and calibration."""

from pyspark.sql import functions as F

from gapwise.bindings.registry import register
from gapwise.bindings.views import (
    BOUNDARIES, FILL_GAP, LABEL_COUNT, LAPS, MAX_RATE, MAX_RATE_GAP, SIG, Views,
)
from gapwise.operators import admission, labels, odometry, smoothing


@register(
    "label_transitions",
    LAPS + """
--
SELECT session_id, frame, time_s, pl AS from_label, lap_number AS to_label,
       lap_number = pl + 1 AS is_increment
FROM (SELECT *, lag(lap_number) OVER (PARTITION BY session_id ORDER BY frame) AS pl FROM laps)
WHERE lap_number <> pl""",
    "time_s",
)
def label_transitions(v: Views):
    return labels.label_transitions(v.laps, v.axis, "lap_number")


# The confirmation rule row by row, as a recursive walk.
WALK = SIG.replace("WITH sig0", "WITH RECURSIVE sig0") + """, n AS (
  SELECT session_id, frame, time_s, raw_lap AS raw,
         row_number() OVER (PARTITION BY session_id ORDER BY frame) AS i FROM sig
), walk AS (
  SELECT session_id, i, frame, time_s, raw, CAST(NULL AS INT) AS before, CAST(NULL AS INT) AS now,
         raw AS pending, CASE WHEN raw IS NULL THEN 0 ELSE 1 END AS cnt,
         CASE WHEN raw IS NULL THEN 0 ELSE 1 END AS shown, time_s AS first_t,
         CAST(NULL AS DOUBLE) AS seen, CAST(NULL AS DOUBLE) AS seen_before
  FROM n WHERE i = 1
  UNION ALL
  SELECT session_id, i, frame, time_s, raw, before,
         CASE WHEN c >= 3 THEN raw ELSE before END,
         CASE WHEN counts AND c < 3 THEN raw END, CASE WHEN counts AND c < 3 THEN c ELSE 0 END,
         CASE WHEN counts THEN c ELSE 0 END, t1,
         CASE WHEN raw = CASE WHEN c >= 3 THEN raw ELSE before END THEN time_s ELSE seen0 END, seen0
  FROM (
    SELECT n.session_id, n.i, n.frame, n.time_s, n.raw, w.now AS before, w.seen AS seen0,
           n.raw IS NOT NULL AND (w.now IS NULL OR n.raw = w.now + 1) AS counts,
           CASE WHEN n.raw IS NOT NULL AND (w.now IS NULL OR n.raw = w.now + 1)
                THEN CASE WHEN w.pending = n.raw THEN w.cnt + 1 ELSE 1 END ELSE 0 END AS c,
           CASE WHEN w.pending = n.raw THEN w.first_t ELSE n.time_s END AS t1
    FROM walk w JOIN n ON n.session_id = w.session_id AND n.i = w.i + 1)
)"""


@register(
    "confirm_labels",
    WALK + """
--
SELECT session_id, frame, now AS confirmed_label,
       CASE WHEN now IS NULL THEN 'missing' WHEN raw = now THEN 'observed' ELSE 'held' END
         AS label_quality,
       CASE WHEN raw IS NULL THEN 0.0 WHEN raw = before THEN 1.0 ELSE least(1.0, shown / 3.0) END
         AS confidence,
       CASE WHEN raw IS NULL THEN 'lap_observation_missing'
            WHEN now IS DISTINCT FROM before AND before IS NULL THEN 'lap_initial_confirmed'
            WHEN now IS DISTINCT FROM before THEN 'lap_boundary_confirmed'
            WHEN raw = before THEN '' WHEN shown > 0 THEN 'lap_confirmation_pending'
            ELSE 'lap_observation_rejected' END AS label_reasons
FROM walk""",
    "confidence",
)
def confirm_labels(v: Views):
    rows = labels.confirm_labels(v.sig, v.axis, "raw_lap", LABEL_COUNT)
    return rows.select(
        "session_id", "frame", "confirmed_label", "label_quality", "confidence", "label_reasons"
    )


@register(
    "confirmed_boundaries",
    WALK + """
--
SELECT session_id, frame, time_s, before AS from_lap, now AS to_lap, 1.0::DOUBLE AS confidence,
       first_t AS first_candidate_time_s, time_s AS confirmed_at_s,
       seen_before AS last_previous_lap_observed_time_s
FROM walk WHERE before IS NOT NULL AND now <> before""",
    "time_s confidence first_candidate_time_s confirmed_at_s last_previous_lap_observed_time_s",
)
def confirmed_boundaries(v: Views):
    return labels.boundaries(labels.confirm_labels(v.sig, v.axis, "raw_lap", LABEL_COUNT), v.axis)


def majority_sql(share: float, least: int, tail: str) -> str:
    """Most frequent element of a list, first seen on ties, with a quorum."""
    return f"""list_filter(list_transform(list_distinct({tail}), lambda x:
        {{'n': len(list_filter({tail}, lambda y: y = x)), 'p': -list_position({tail}, x), 'x': x}}),
        lambda z: z.n >= greatest(len({tail}) * {share}, {least}))"""


VOTES = SIG.replace("WITH sig0", "WITH RECURSIVE sig0") + """, tails AS (
  SELECT session_id, frame, list({col}) OVER (PARTITION BY session_id ORDER BY frame
           ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS tail
  FROM sig WHERE {col} IS NOT NULL
), modes AS (
  SELECT session_id, frame, tail, list_sort(""" + majority_sql(0.7, 3, "tail") + """, 'DESC')[1] AS top,
         list_sort(list_transform(list_distinct(tail), lambda x:
           {{'n': len(list_filter(tail, lambda y: y = x)), 'p': -list_position(tail, x)}}), 'DESC')[1] AS best
  FROM tails
), votes AS (
  SELECT session_id, frame, CASE WHEN top.n = best.n AND top.p = best.p THEN top.x END AS vote
  FROM modes
)"""
LAP_VOTES = VOTES.replace("{col}", "raw_lap").replace("{{", "{").replace("}}", "}")
GEAR_VOTES = VOTES.replace("{col}", "gear").replace("{{", "{").replace("}}", "}")
SMOOTHED = LAP_VOTES + """, m AS (
  SELECT s.session_id, s.frame, s.raw_lap, v.vote,
         row_number() OVER (PARTITION BY s.session_id ORDER BY s.frame) AS i
  FROM sig s LEFT JOIN votes v ON s.session_id = v.session_id AND s.frame = v.frame
), w AS (
  SELECT session_id, frame, raw_lap, i, vote AS label FROM m WHERE i = 1
  UNION ALL
  SELECT m.session_id, m.frame, m.raw_lap, m.i,
         CASE WHEN m.vote IS NOT NULL AND (w.label IS NULL OR m.vote = w.label + 1) THEN m.vote
              ELSE w.label END
  FROM w JOIN m ON m.session_id = w.session_id AND m.i = w.i + 1
)"""


@register(
    "rolling_majority",
    SMOOTHED + "\n--\nSELECT session_id, frame, label AS smoothed_label FROM w",
)
def rolling_majority(v: Views):
    rows = labels.rolling_majority(v.sig, v.axis, "raw_lap")
    return rows.select("session_id", "frame", "smoothed_label")


@register(
    "rolling_majority_free",
    GEAR_VOTES + """
--
SELECT s.session_id, s.frame, last_value(v.vote IGNORE NULLS)
         OVER (PARTITION BY s.session_id ORDER BY s.frame) AS smoothed_label
FROM sig s LEFT JOIN votes v ON s.session_id = v.session_id AND s.frame = v.frame""",
)
def rolling_majority_free(v: Views):
    rows = labels.rolling_majority(v.sig, v.axis, "gear", successors_only=False)
    return rows.select("session_id", "frame", "smoothed_label")


@register(
    "close_labels",
    SMOOTHED + """, ends AS (
  SELECT session_id, arg_max(tail, frame) AS tail FROM tails GROUP BY session_id
), final AS (
  SELECT session_id, list_sort(""" + majority_sql(0.3, 1, "tail") + """, 'DESC')[1] AS top,
         list_sort(list_transform(list_distinct(tail), lambda x:
           {'n': len(list_filter(tail, lambda y: y = x)), 'p': -list_position(tail, x)}), 'DESC')[1] AS best
  FROM ends
), last AS (
  SELECT session_id, arg_max_null(label, frame) AS last_label FROM w GROUP BY session_id
), o AS (
  SELECT w.session_id, max(frame) FILTER (WHERE label IS DISTINCT FROM last_label) AS other
  FROM w JOIN last USING (session_id) GROUP BY w.session_id
), j AS (
  SELECT w.*, last_label, other,
         CASE WHEN top.n = best.n AND top.p = best.p THEN top.x END AS final_vote
  FROM w JOIN last USING (session_id) JOIN o USING (session_id) LEFT JOIN final USING (session_id)
)
--
SELECT session_id, frame,
       CASE WHEN final_vote = last_label + 1 AND frame > coalesce(other, -1) THEN final_vote
            ELSE label END AS final_label,
       coalesce(final_vote = last_label + 1 AND frame > coalesce(other, -1), FALSE) AS relabelled
FROM j""",
)
def close_labels(v: Views):
    rows = labels.rolling_majority(v.sig, v.axis, "raw_lap")
    rows = labels.close_labels(rows, v.axis, "raw_lap")
    return rows.select("session_id", "frame", "final_label", "relabelled")


@register(
    "admit_rate",
    SIG.replace("WITH sig0", "WITH RECURSIVE sig0") + """, n AS (
  SELECT session_id, frame, time_s AS t, value AS v, q,
         row_number() OVER (PARTITION BY session_id ORDER BY frame) AS i FROM sig
), walk AS (
  SELECT session_id, frame, i, q, v, CASE WHEN q = 'observed' THEN t END AS pt,
         CASE WHEN q = 'observed' THEN v END AS pv, FALSE AS rejected
  FROM n WHERE i = 1
  UNION ALL
  SELECT session_id, frame, i, q, v, CASE WHEN q = 'observed' AND NOT bad THEN t END,
         CASE WHEN q = 'observed' AND NOT bad THEN v END, q = 'observed' AND bad
  FROM (SELECT n.*, coalesce(n.t - w.pt <= 24 AND abs(n.v - w.pv) > 5.0 * (n.t - w.pt)
                 AND abs(abs(n.v - w.pv) - 5.0 * (n.t - w.pt))
                     > 1e-9 * greatest(abs(n.v - w.pv), 5.0 * (n.t - w.pt)), FALSE) AS bad
        FROM walk w JOIN n ON n.session_id = w.session_id AND n.i = w.i + 1)
)
--
SELECT session_id, frame, CASE WHEN NOT rejected THEN v END AS value,
       CASE WHEN rejected THEN 'anomalous' ELSE q END AS quality,
       CASE WHEN rejected THEN 'speed_rate_exceeded' END AS admission_reason
FROM walk""",
    "value",
)
def admit_rate(v: Views):
    rows = v.sig.withColumn("quality", F.col("q"))
    rows = admission.admit_rate(rows, v.axis, max_rate=MAX_RATE, max_gap=MAX_RATE_GAP)
    return rows.select("session_id", "frame", "value", "quality", "admission_reason")


FILLED = """, f0 AS (
  SELECT *, CASE WHEN q = 'observed' AND value >= 0 THEN value END AS x FROM sig
), f1 AS (
  SELECT *, last_value(CASE WHEN x IS NOT NULL THEN time_s END IGNORE NULLS) OVER w AS lt,
         last_value(x IGNORE NULLS) OVER w AS lx,
         first_value(CASE WHEN x IS NOT NULL THEN time_s END IGNORE NULLS) OVER u AS rt,
         first_value(x IGNORE NULLS) OVER u AS rx
  FROM f0 WINDOW w AS (PARTITION BY session_id ORDER BY frame),
                 u AS (PARTITION BY session_id ORDER BY frame
                       ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), filled AS (
  SELECT *, x IS NULL AND coalesce(rt - lt > 0 AND rt - lt <= 24, FALSE) AS was_filled,
         CASE WHEN x IS NOT NULL THEN x WHEN rt - lt > 0 AND rt - lt <= 24
              THEN lx + (time_s - lt) / (rt - lt) * (rx - lx) END AS filled_value
  FROM f1
)"""


@register(
    "fill_bounded",
    SIG + FILLED + "\n--\nSELECT session_id, frame, x, filled_value, was_filled FROM filled",
    "x filled_value",
)
def fill_bounded(v: Views):
    x = F.when((F.col("q") == "observed") & (F.col("value") >= 0), F.col("value"))
    rows = odometry.fill_bounded(v.sig.withColumn("x", x), v.axis, "x", FILL_GAP)
    return rows.select("session_id", "frame", "x", "filled_value", "was_filled")


ODO = FILLED + """, o1 AS (
  SELECT *, lag(time_s) OVER w AS pt, lag(filled_value) OVER w AS pv, lag(was_filled) OVER w AS pf,
         row_number() OVER w AS i
  FROM filled WINDOW w AS (PARTITION BY session_id ORDER BY frame)
), o2 AS (
  SELECT *, CASE WHEN i > 1 AND filled_value IS NOT NULL AND pv IS NOT NULL
                 THEN (pv + filled_value) / 2 / 3.6 * (time_s - pt) END AS delta,
         CASE WHEN i = 1 THEN 0.0
              WHEN filled_value IS NULL OR pv IS NULL OR was_filled OR pf THEN 0.001
              ELSE 0.00005 END * coalesce(time_s - pt, 0.0) AS u
  FROM o1
), odo AS (
  SELECT session_id, frame, time_s, event_id, s, lap_number, delta AS delta_distance_m,
         sum(coalesce(delta, 0)) OVER w AS distance_m,
         least(1.0, sum(u) OVER w) AS odometry_uncertainty,
         CASE WHEN i = 1 THEN CASE WHEN filled_value IS NULL THEN 'missing' ELSE 'observed' END
              WHEN filled_value IS NULL OR pv IS NULL THEN 'missing'
              WHEN was_filled OR pf THEN 'interpolated' ELSE 'observed' END AS odometry_source,
         CASE WHEN i = 1 THEN CASE WHEN filled_value IS NULL THEN 'speed_missing' ELSE '' END
              WHEN filled_value IS NULL OR pv IS NULL THEN 'speed_missing'
              WHEN was_filled OR pf THEN 'speed_gap_interpolated' ELSE '' END AS odometry_reasons
  FROM o2 WINDOW w AS (PARTITION BY session_id ORDER BY frame)
)"""


def odo(v: Views):
    return odometry.integrate(v.sig, v.axis, speed="value", quality="q", max_gap=FILL_GAP)


@register(
    "integrate",
    SIG + ODO + """
--
SELECT session_id, frame, delta_distance_m, distance_m, odometry_uncertainty, odometry_source,
       odometry_reasons FROM odo""",
    "delta_distance_m distance_m odometry_uncertainty",
)
def integrate(v: Views):
    return odo(v).select(
        "session_id", "frame", "delta_distance_m", "distance_m", "odometry_uncertainty",
        "odometry_source", "odometry_reasons",
    )


LENGTH = 3000.0


@register(
    "segment_fraction",
    BOUNDARIES + ODO + """, d AS (
  SELECT o.session_id, o.frame, o.distance_m,
         last_value(CASE WHEN b.frame IS NOT NULL THEN o.distance_m END IGNORE NULLS)
           OVER (PARTITION BY o.session_id ORDER BY o.frame) AS d0
  FROM odo o LEFT JOIN boundaries b ON o.session_id = b.session_id AND o.frame = b.frame
)
--
SELECT session_id, frame, CASE WHEN d0 IS NOT NULL
       THEN greatest(0.0, least(1.0, (distance_m - d0) / 3000.0)) END AS fraction
FROM d""",
    "fraction",
)
def segment_fraction(v: Views):
    marks = v.boundaries.select("session_id", "frame", F.lit(True).alias("b"))
    rows = odo(v).join(marks, ["session_id", "frame"], "left")
    rows = rows.withColumns({"b": F.coalesce("b", F.lit(False)), "length": F.lit(LENGTH)})
    rows = odometry.segment_fraction(rows, v.axis, "b", "length")
    return rows.select("session_id", "frame", "fraction")


LAP_DIST = BOUNDARIES + ODO + """, ends AS (
  SELECT session_id, to_lap, time_s, lead(time_s) OVER (PARTITION BY session_id ORDER BY frame) AS nt
  FROM boundaries
), lap_dist AS (
  SELECT e.session_id, e.to_lap AS lap_number, e.time_s AS start_time_s, e.nt AS end_time_s,
         arg_max(o.distance_m, o.frame) FILTER (WHERE o.time_s <= e.nt)
           - arg_max(o.distance_m, o.frame) FILTER (WHERE o.time_s <= e.time_s) AS distance_m,
         coalesce(count(*) FILTER (WHERE o.time_s > e.time_s AND o.time_s <= e.nt
                                   AND odometry_source = 'missing')
           / nullif(count(*) FILTER (WHERE o.time_s > e.time_s AND o.time_s <= e.nt), 0), 1.0)
           AS missing_fraction
  FROM ends e JOIN odo o ON e.session_id = o.session_id
  WHERE e.nt IS NOT NULL GROUP BY ALL
)"""


def lap_dist(v: Views):
    return odometry.lap_distances(odo(v), v.boundaries, v.axis)


@register(
    "lap_distances",
    LAP_DIST + "\n--\nSELECT *, TRUE AS complete, '' AS reasons FROM lap_dist",
    "start_time_s end_time_s distance_m missing_fraction",
)
def lap_distances(v: Views):
    return lap_dist(v)


# Few laps exist per session, so calibration groups the sessions by their last digit.
JUDGED = LAP_DIST + """, g AS (
  SELECT *, session_id % 10 AS track FROM lap_dist
), el AS (
  SELECT *, end_time_s - start_time_s > 0 AND distance_m > 0 AND missing_fraction <= 0.8 AS ok,
         end_time_s - start_time_s AS dur FROM g
), c AS (
  SELECT track, count(*) AS n, quantile_cont(distance_m, 0.5) AS dm, quantile_cont(dur, 0.5) AS tm
  FROM el WHERE ok GROUP BY track
), judged AS (
  SELECT el.*, c.n, coalesce(ok AND n >= 3 AND abs(distance_m - dm) / dm > 0.4, FALSE) AS far,
         coalesce(ok AND n >= 3 AND abs(dur - tm) / tm > 0.4, FALSE) AS slow
  FROM el LEFT JOIN c USING (track)
), laps_judged AS (
  SELECT *, ok AND NOT far AND NOT slow AS accepted,
         CASE WHEN ok AND NOT far AND NOT slow THEN ''
              WHEN dur <= 0 THEN 'non_positive_duration;calibration_lap_rejected'
              WHEN far THEN 'distance_outlier;calibration_lap_rejected'
              WHEN slow THEN 'duration_outlier;calibration_lap_rejected'
              ELSE 'calibration_lap_rejected' END AS reasons
  FROM judged
)"""


def judged(v: Views):
    laps = lap_dist(v).withColumn("track", F.col("session_id") % 10)
    return odometry.judge_laps(laps, ("track",), max_missing=0.8, max_deviation=0.4)


@register(
    "judge_laps",
    JUDGED + """
--
SELECT session_id, lap_number, distance_m, accepted, reasons FROM laps_judged""",
    "distance_m",
)
def judge_laps(v: Views):
    return judged(v).select("session_id", "lap_number", "distance_m", "accepted", "reasons")


@register(
    "calibrate_length",
    JUDGED + """, mid AS (
  SELECT track, quantile_cont(distance_m, 0.5) AS m FROM laps_judged WHERE accepted GROUP BY track
), mad AS (
  SELECT track, quantile_cont(abs(distance_m - m), 0.5) / any_value(m) AS r
  FROM laps_judged JOIN mid USING (track) WHERE accepted GROUP BY track
), n AS (
  SELECT track, count(*) FILTER (WHERE accepted) AS accepted_laps,
         count(*) FILTER (WHERE NOT accepted) AS rejected_laps FROM laps_judged GROUP BY track
)
--
SELECT track, accepted_laps, rejected_laps, m AS effective_length_m, r AS relative_mad,
       least(1.0, CASE WHEN m IS NULL THEN 1.0 WHEN accepted_laps = 1 THEN 0.4 ELSE r END)
         AS uncertainty
FROM n LEFT JOIN mid USING (track) LEFT JOIN mad USING (track)""",
    "effective_length_m relative_mad uncertainty",
)
def calibrate_length(v: Views):
    return odometry.calibrate_length(judged(v), ("track",), max_deviation=0.4)


@register(
    "median_with_recovery",
    SIG.replace("WITH sig0", "WITH RECURSIVE sig0") + """, n AS (
  SELECT session_id, frame, CASE WHEN k BETWEEN 0 AND 400 THEN CAST(k AS BIGINT) END AS x,
         row_number() OVER (PARTITION BY session_id ORDER BY frame) AS i
  FROM (SELECT session_id, frame, CASE WHEN event_id % 12 = 0 THEN NULL
               WHEN event_id % 18 = 0 THEN 999 ELSE CAST(k AS INT) // 12 * 8 END AS k FROM sig)
), walk AS (
  SELECT session_id, frame, i, x AS valid, CASE WHEN x IS NULL THEN []::BIGINT[] ELSE [x] END AS h,
         []::BIGINT[] AS p, CASE WHEN x IS NULL THEN 'none' ELSE 'observed' END AS quality
  FROM n WHERE i = 1
  UNION ALL
  SELECT session_id, frame, i,
         CASE WHEN promoted THEN CAST(floor(list_aggregate(np, 'median')) AS BIGINT)
              WHEN used THEN CAST(floor(list_aggregate(nh, 'median')) AS BIGINT) ELSE valid END,
         CASE WHEN promoted THEN list_transform(range(4),
                lambda z: CAST(floor(list_aggregate(np, 'median')) AS BIGINT))
              WHEN used THEN nh ELSE h END,
         CASE WHEN promoted OR used OR x IS NULL THEN []::BIGINT[] ELSE np END,
         CASE WHEN promoted OR used THEN 'observed' WHEN valid IS NOT NULL THEN 'held' ELSE 'none' END
  FROM (SELECT *, NOT used AND x IS NOT NULL AND len(np) >= 4 AS promoted
        FROM (SELECT n.session_id, n.frame, n.i, n.x, w.valid, w.h,
               n.x IS NOT NULL AND (w.valid IS NULL OR abs(n.x - w.valid) <= 20) AS used,
               list_concat(w.h, [n.x])[-4:] AS nh,
               CASE WHEN len(w.p) > 0 AND abs(n.x - w.p[-1]) <= 8
                    THEN list_concat(w.p, [n.x]) ELSE [n.x] END AS np
        FROM walk w JOIN n ON n.session_id = w.session_id AND n.i = w.i + 1))
)
--
SELECT session_id, frame, CAST(valid AS INT) AS speed,
       quality = 'observed' AS is_observed, quality = 'held' AS is_held FROM walk""",
)
def median_with_recovery(v: Views):
    e = F.col("event_id")
    text = (
        F.when(e % 12 == 0, "")
        .when(e % 18 == 0, "9x99")
        .otherwise((F.floor(F.col("k") / 12) * 8).cast("int").cast("string"))
    )
    rows = smoothing.median_with_recovery(
        v.sig.withColumn("raw", text), v.axis, "raw", size=4, max_delta=20, tolerance=8
    )
    return rows.select(
        "session_id", "frame", "speed", (F.col("speed_quality") == "observed").alias("is_observed"),
        (F.col("speed_quality") == "held").alias("is_held"),
    )


@register(
    "validate_position",
    LAPS.replace("WITH sig0", "WITH RECURSIVE sig0") + """, n AS (
  SELECT session_id, lap_number, frame, CASE WHEN event_id % 15 <> 0 THEN s * 100 END AS raw,
         row_number() OVER (PARTITION BY session_id, lap_number ORDER BY frame) AS i FROM laps
), walk AS (
  SELECT session_id, lap_number, frame, 0::BIGINT AS i, 0.0::DOUBLE AS p, '' AS decision
  FROM n WHERE i = 1
  UNION ALL
  SELECT session_id, lap_number, frame, i,
         CASE WHEN raw IS NULL THEN p WHEN p > 95 AND x < 5 THEN x WHEN x < p THEN p
              WHEN x - p > 8 THEN p + 8 WHEN p = 0 THEN x
              WHEN x - (0.3 * x + 0.7 * p) > 0.5 THEN x - 0.2 ELSE 0.3 * x + 0.7 * p END,
         CASE WHEN raw IS NULL THEN 'missing_held' WHEN done THEN 'forced_completion'
              WHEN p > 95 AND x < 5 THEN 'observed' WHEN x < p THEN 'backward_held'
              WHEN x - p > 8 THEN 'jump_clamped' WHEN p = 0 THEN 'observed' ELSE 'smoothed' END
  FROM (SELECT n.session_id, n.lap_number, n.frame, n.i, n.raw, w.p,
               coalesce(w.p > 90 AND n.raw < 90 AND w.p - n.raw > 3, FALSE) AS done,
               CASE WHEN w.p > 90 AND n.raw < 90 AND w.p - n.raw > 3 THEN 100.0
                    ELSE least(100.0, greatest(0.0, n.raw)) END AS x
        FROM walk w JOIN n ON n.session_id = w.session_id AND n.lap_number = w.lap_number
         AND n.i = w.i + 1)
)
--
SELECT session_id, lap_number, frame, p AS validated_position, decision FROM walk WHERE i > 0""",
    "validated_position",
)
def validate_position(v: Views):
    raw = F.when(F.col("event_id") % 15 != 0, F.col("s") * 100)
    rows = smoothing.validate_position(
        v.laps.withColumn("raw", raw), v.axis.within("lap_number"), "raw", max_jump=8.0
    )
    return rows.select("session_id", "lap_number", "frame", "validated_position", "decision")
