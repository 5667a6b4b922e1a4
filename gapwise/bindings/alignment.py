"""Queries on resampling, lap comparison, geometry and fusion."""

from pyspark.sql import functions as F


from gapwise.bindings.distance import LENGTH, ODO, odo
from gapwise.bindings.registry import register
from gapwise.bindings.views import (
    BOUNDARIES, FILL_GAP, GRID_STEP, LABEL_COUNT, POSITION_GAP, SIG, TIME_GAP, Views,
)
from gapwise.operators import align, fusion, geometry, joins
from gapwise.ordered import Axis, plan_axis
from gapwise.plans import jobs

KEY = ("session_id",)
CHANNELS = {
    "throttle": ("throttle", None),
    "brake": ("brake", "q"),
    "steering": ("steering", None),
    "speed": ("speed", None),
    "time": ("time_s", None),
    "frame": ("frame", None),
}

GRID = BOUNDARIES + """, once AS (
  SELECT session_id, lap_number, s FROM laps GROUP BY ALL HAVING count(*) = 1
), base AS (
  SELECT l.*, o.s IS NOT NULL AND l.s BETWEEN 0 AND 1 AS fits
  FROM laps l LEFT JOIN once o USING (session_id, lap_number, s)
), long AS (
  SELECT session_id, lap_number, frame, time_s, s, 'throttle' AS channel, throttle AS x,
         'observed' AS flag, fits FROM base
  UNION ALL SELECT session_id, lap_number, frame, time_s, s, 'brake', brake, q, fits FROM base
  UNION ALL SELECT session_id, lap_number, frame, time_s, s, 'steering', steering, 'observed', fits
            FROM base
  UNION ALL SELECT session_id, lap_number, frame, time_s, s, 'speed', speed, 'observed', fits FROM base
  UNION ALL SELECT session_id, lap_number, frame, time_s, s, 'time', time_s, 'observed', fits FROM base
  UNION ALL SELECT session_id, lap_number, frame, time_s, s, 'frame', frame, 'observed', fits FROM base
), g AS (
  SELECT *, fits AND x IS NOT NULL AND flag = 'observed' AS good FROM long
), l1 AS (
  SELECT *, lag(s) OVER w AS ps, lag(time_s) OVER w AS pt, lag(x) OVER w AS px, lag(good) OVER w AS pg
  FROM g WINDOW w AS (PARTITION BY session_id, lap_number, channel ORDER BY frame)
), l2 AS (
  SELECT *, good AND coalesce(pg AND s > ps AND s - ps <= 0.1 * (1 + 4e-15)
                    AND time_s > pt AND time_s - pt <= 48 * (1 + 4e-15), FALSE) AS joined FROM l1
), l3 AS (
  SELECT *, sum((good AND NOT joined)::INT) OVER (PARTITION BY session_id, lap_number, channel
              ORDER BY frame) - 1 AS run FROM l2
), hits AS (
  SELECT session_id, lap_number, channel, k, run,
         CASE WHEN k * 0.05::DOUBLE = s THEN x
              ELSE px + (k * 0.05::DOUBLE - ps) / (s - ps) * (x - px) END AS value,
         CASE WHEN k * 0.05::DOUBLE = s THEN flag ELSE 'interpolated' END AS quality
  FROM l3, range(21) t(k)
  WHERE good AND (k * 0.05::DOUBLE = s
                  OR (joined AND k * 0.05::DOUBLE > ps AND k * 0.05::DOUBLE < s))
), claims AS (
  SELECT session_id, lap_number, channel, k, count(*) AS n, max(value) AS value,
         max(quality) AS quality, max(run) AS run FROM hits GROUP BY ALL
), starts AS (
  SELECT session_id, to_lap AS lap_number,
         CASE WHEN count(*) = 1 THEN min(time_s) END AS lap_start_time_s
  FROM boundaries GROUP BY ALL
), grid AS (
  SELECT d.session_id, d.lap_number, c.channel, t.k, k * 0.05::DOUBLE * 100 AS position,
         CASE WHEN n = 1 THEN value END AS value,
         CASE WHEN n = 1 THEN quality WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS quality,
         CAST(CASE WHEN n = 1 THEN run ELSE -1 END AS BIGINT) AS run, lap_start_time_s
  FROM (SELECT DISTINCT session_id, lap_number FROM laps) d
  CROSS JOIN (SELECT DISTINCT channel FROM long) c CROSS JOIN range(21) t(k)
  LEFT JOIN claims USING (session_id, lap_number, channel, k)
  LEFT JOIN starts USING (session_id, lap_number)
)"""


def marked_laps(v: Views):
    why = F.when(F.col("starts"), F.array(F.lit(align.CONFIRMED_START)))
    return v.lap_starts.withColumn(
        "s_reasons", F.coalesce(why, F.array().cast("array<string>"))
    )


def grid(v: Views):
    laps = marked_laps(v)
    return align.resample_on_grid(
        laps,
        v.axis,
        step=GRID_STEP,
        max_position_gap=POSITION_GAP,
        max_time_gap=TIME_GAP,
        channels=CHANNELS,
        start_times=align.confirmed_starts(laps, KEY, "s_reasons"),
    )


@register(
    "resample_on_grid",
    GRID + "\n--\nSELECT * FROM grid",
    "position value lap_start_time_s",
)
def resample_on_grid(v: Views):
    return grid(v)


DELTA = GRID + """, wide AS (
  SELECT session_id, lap_number, k, position, lap_start_time_s,
         max(value) FILTER (WHERE channel = 'time') AS time,
         max(value) FILTER (WHERE channel = 'throttle') AS throttle,
         max(value) FILTER (WHERE channel = 'brake') AS brake,
         max(value) FILTER (WHERE channel = 'steering') AS steering,
         max(value) FILTER (WHERE channel = 'speed') AS speed
  FROM grid GROUP BY ALL
), lap_pairs AS (
  SELECT a.session_id, a.lap_number AS lap_a, b.lap_number AS lap_b, a.position,
         a.time AS ta, b.time AS tb, (a.time - a.lap_start_time_s) - (b.time - b.lap_start_time_s)
           AS delta_s,
         CASE WHEN b.throttle IS NOT NULL THEN a.throttle END AS throttle_a,
         CASE WHEN a.throttle IS NOT NULL THEN b.throttle END AS throttle_b,
         CASE WHEN b.brake IS NOT NULL THEN a.brake END AS brake_a,
         CASE WHEN a.brake IS NOT NULL THEN b.brake END AS brake_b,
         CASE WHEN b.steering IS NOT NULL THEN a.steering END AS steering_a,
         CASE WHEN a.steering IS NOT NULL THEN b.steering END AS steering_b,
         CASE WHEN b.speed IS NOT NULL THEN a.speed END AS speed_a,
         CASE WHEN a.speed IS NOT NULL THEN b.speed END AS speed_b
  FROM wide a JOIN wide b ON a.session_id = b.session_id AND a.k = b.k
   AND a.lap_number < b.lap_number
)"""


@register(
    "time_delta",
    DELTA + """
--
SELECT session_id, lap_a, lap_b, position, delta_s FROM lap_pairs
WHERE lap_b = (SELECT min(l.lap_number) FROM laps l
               WHERE l.session_id = lap_pairs.session_id AND l.lap_number > lap_a)""",
    "position delta_s",
)
def time_delta(v: Views):
    """Every lap against the next one of its session."""
    wide = align.grid_wide(grid(v), KEY, list(CHANNELS))
    rows = joins.time_deltas(wide, joins.adjacent_pairs(v.laps, v.axis), KEY)
    return rows.select("session_id", "lap_a", "lap_b", "position", "delta_s")


@register(
    "compare_laps_by_position",
    DELTA + """
--
SELECT session_id, lap_a, lap_b, position, delta_s, throttle_a, throttle_b, brake_a, brake_b,
       steering_a, steering_b, speed_a, speed_b
FROM lap_pairs
WHERE lap_b = (SELECT min(l.lap_number) FROM laps l
               WHERE l.session_id = lap_pairs.session_id AND l.lap_number > lap_a)""",
    "position delta_s throttle_a throttle_b brake_a brake_b steering_a steering_b speed_a speed_b",
)
def compare_laps_by_position(v: Views):
    """Every lap of every session against the next one."""
    laps = marked_laps(v)
    rows = jobs.compare_laps_by_position(
        laps,
        v.axis,
        joins.adjacent_pairs(v.laps, v.axis),
        step=GRID_STEP,
        max_position_gap=POSITION_GAP,
        max_time_gap=TIME_GAP,
        channels=CHANNELS,
        start_times=align.confirmed_starts(laps, KEY, "s_reasons"),
    )
    return rows.select(
        "session_id", "lap_a", "lap_b", "position", "delta_s", "throttle_a", "throttle_b",
        "brake_a", "brake_b", "steering_a", "steering_b", "speed_a", "speed_b",
    )


# --- geometry -------------------------------------------------------------------------

VERTICES = 64
RADIUS = 0.2
MAX_DISTANCE = 0.05


def ring(v: Views):
    """A circle of 64 vertices.  The track's number comes with the embeddings' table."""
    turn = F.col("idx") * (2 * 3.141592653589793 / VERTICES)
    rows = v.table("embeddings").agg(F.min(F.lit(0)).alias("track_id"))
    rows = rows.select("track_id", F.explode(F.sequence(F.lit(0), F.lit(VERTICES - 1))).alias("idx"))
    return rows.select("track_id", "idx", (F.cos(turn) * RADIUS).alias("x"),
                       (F.sin(turn) * RADIUS).alias("y"))


def points(v: Views):
    e = F.col("embedding")
    return v.table("embeddings").select(
        "vec_id", F.lit(0).alias("track_id"), e[0].cast("double").alias("x"),
        e[1].cast("double").alias("y"), F.col("label"),
    )


RING = """WITH ring AS (
  SELECT 0 AS track_id, i AS idx, cos(i * (2 * 3.141592653589793::DOUBLE / 64)) * 0.2::DOUBLE AS x,
         sin(i * (2 * 3.141592653589793::DOUBLE / 64)) * 0.2::DOUBLE AS y FROM range(64) t(i)
), seg0 AS (
  SELECT *, coalesce(lead(x) OVER (ORDER BY idx), first_value(x) OVER (ORDER BY idx)) AS x1,
         coalesce(lead(y) OVER (ORDER BY idx), first_value(y) OVER (ORDER BY idx)) AS y1 FROM ring
), seg AS (
  SELECT *, sum(len) OVER (ORDER BY idx) - len AS start_arc, sum(len) OVER () AS total
  FROM (SELECT *, sqrt((x1 - x) * (x1 - x) + (y1 - y) * (y1 - y)) AS len FROM seg0)
), points AS (
  SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, label
  FROM embeddings
)"""
PROJ = RING + """, m0 AS (
  SELECT vec_id, p.label, p.x, p.y, s.idx, s.x AS ax, s.y AS ay, x1, y1, len, start_arc, total,
         greatest(0.0, least(1.0, ((p.x - s.x) * (x1 - s.x) + (p.y - s.y) * (y1 - s.y))
           / ((x1 - s.x) * (x1 - s.x) + (y1 - s.y) * (y1 - s.y)))) AS f
  FROM points p, seg s
), m1 AS (
  SELECT *, ax + f * (x1 - ax) AS px, ay + f * (y1 - ay) AS py FROM m0
), m2 AS (
  SELECT *, sqrt((x - px) * (x - px) + (y - py) * (y - py)) AS distance,
         (start_arc + f * len) / total - floor((start_arc + f * len) / total) AS s_visual FROM m1
), m3 AS (
  SELECT *, idx - row_number() OVER (PARTITION BY vec_id ORDER BY idx) AS island
  FROM m2 WHERE distance <= 0.05
), proj AS (
  SELECT vec_id, label, x, y, idx AS segment, s_visual, distance, px, py
  FROM m3 QUALIFY row_number() OVER (PARTITION BY vec_id, island
                                     ORDER BY distance, s_visual, py, px) = 1
)"""


def proj(v: Views):
    return geometry.project_points(points(v), ring(v), MAX_DISTANCE, ("vec_id",))


@register(
    "project_points",
    PROJ + """
--
SELECT vec_id, s_visual, distance, px, py,
       row_number() OVER (PARTITION BY vec_id ORDER BY distance, s_visual, py, px) AS rank
FROM proj""",
    "s_visual distance px py",
)
def project_points(v: Views):
    rows = geometry.rank_projections(proj(v), ("vec_id",))
    return rows.select("vec_id", "s_visual", "distance", "px", "py", "rank")


ROUTES = SIG + """, route AS (
  SELECT session_id AS track_id, frame AS idx,
         cos(frame * 0.1::DOUBLE) * (0.2::DOUBLE + k / 1000) AS x,
         sin(frame * 0.1::DOUBLE) * (0.2::DOUBLE + k / 1000) AS y FROM sig
), seg0 AS (
  SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x1,
         coalesce(lead(y) OVER w, first_value(y) OVER w) AS y1
  FROM route WINDOW w AS (PARTITION BY track_id ORDER BY idx)
), seg AS (
  SELECT *, sum(len) OVER (PARTITION BY track_id ORDER BY idx) - len AS start_arc,
         sum(len) OVER (PARTITION BY track_id) AS total
  FROM (SELECT *, sqrt((x1 - x) * (x1 - x) + (y1 - y) * (y1 - y)) AS len FROM seg0)
)"""


@register(
    "resample_closed_path",
    ROUTES + """
--
SELECT track_id, CAST(k AS BIGINT) AS idx, k * 0.0331::DOUBLE AS arc,
       x + (k * 0.0331::DOUBLE - start_arc) / len * (x1 - x) AS x,
       y + (k * 0.0331::DOUBLE - start_arc) / len * (y1 - y) AS y
FROM (SELECT *, unnest(range(CAST(floor(total / 0.0331::DOUBLE) AS BIGINT) + 2)) AS k FROM seg)
WHERE len > 0 AND k * 0.0331::DOUBLE >= start_arc AND k * 0.0331::DOUBLE < start_arc + len
  AND k * 0.0331::DOUBLE < total""",
    "arc x y",
)
def resample_closed_path(v: Views):
    """A closed route per session, one vertex per row of its signal."""
    turn, radius = F.col("frame") * 0.1, F.lit(0.2) + F.col("k") / 1000
    routes = v.sig.select(
        F.col("session_id").alias("track_id"), F.col("frame").alias("idx"),
        (F.cos(turn) * radius).alias("x"), (F.sin(turn) * radius).alias("y"),
    )
    along = Axis(("track_id",), ("idx",), v.axis.width)
    rows = geometry.resample_closed_path(routes, 0.0331, along)
    return rows.select("track_id", "idx", "arc", "x", "y")


PATH = RING + """, near AS (
  SELECT vec_id, label, arg_min(idx, ((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y), idx)) AS vertex,
         arg_min(start_arc, ((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y), idx)) AS arc,
         any_value(total) AS total
  FROM points p, seg s GROUP BY vec_id, label
), fwd AS (
  SELECT *, ((arc - 0.1) / total - floor((arc - 0.1) / total)) * 100 AS forward FROM near
), d AS (
  SELECT *, CASE WHEN forward = 0 THEN 0.0 ELSE 100.0 - forward END AS reverse FROM fwd
), dir AS (
  SELECT label, arg_min(CASE WHEN forward <= reverse THEN 1 ELSE -1 END, vec_id) AS direction,
         min(vec_id) AS since
  FROM d WHERE least(forward, reverse) > 0.02 GROUP BY label
)"""


@register(
    "path_position",
    PATH + """
--
SELECT vec_id, d.label, vertex, CASE WHEN vec_id >= since THEN direction END AS direction,
       CASE WHEN since IS NULL OR vec_id < since THEN 0.0
            WHEN direction = 1 THEN forward ELSE reverse END AS position
FROM d LEFT JOIN dir ON d.label IS NOT DISTINCT FROM dir.label""",
    "position",
)
def path_position(v: Views):
    rows = points(v).withColumn("start_arc0", F.lit(0.1))
    axis = plan_axis(rows, ("label",), ("vec_id",), unique_step=True)
    rows = geometry.path_position(rows, ring(v), axis, "start_arc0")
    return rows.select("vec_id", "label", "vertex", "direction", "position")


# --- choice of projections ------------------------------------------------------------

MARGIN = 0.15


def scored(v: Views):
    return proj(v).withColumn("score", F.col("distance") / MAX_DISTANCE)


@register(
    "unique_best",
    PROJ + """, r AS (
  SELECT label % 8 AS grp, distance / 0.05 AS score, s_visual, x, y,
         row_number() OVER (PARTITION BY label % 8 ORDER BY distance / 0.05, s_visual, y, x) AS rn
  FROM proj
), t AS (
  SELECT a.grp, a.score, a.s_visual, a.x, a.y,
         b.score IS NULL OR NOT (b.score - a.score < 0.01
                                 OR abs(b.score - a.score) <= 1e-9 * greatest(a.score, b.score)) AS u
  FROM r a LEFT JOIN r b ON a.grp = b.grp AND b.rn = 2 WHERE a.rn = 1
)
--
SELECT grp, CASE WHEN u THEN score END AS score, CASE WHEN u THEN s_visual END AS s_visual,
       CASE WHEN u THEN x END AS x, CASE WHEN u THEN y END AS y, u AS is_unique FROM t""",
    "score s_visual x y",
)
def unique_best(v: Views):
    labels = v.table("embeddings").select("vec_id", (F.col("label") % 8).alias("grp"))
    rows = scored(v).join(labels, "vec_id")
    return fusion.unique_best(rows, ("grp",), "score", 0.01)


@register(
    "infer_direction",
    PROJ + """, e AS (
  SELECT vec_id, (s_visual - 0.3) - floor(s_visual - 0.3) - 0.25 AS f0,
         (0.3 - s_visual) - floor(0.3 - s_visual) - 0.25 AS b0 FROM proj
), a AS (
  SELECT vec_id, abs(CASE WHEN f0 - floor(f0) > 0.5 THEN f0 - floor(f0) - 1 ELSE f0 - floor(f0) END) AS f,
         abs(CASE WHEN b0 - floor(b0) > 0.5 THEN b0 - floor(b0) - 1 ELSE b0 - floor(b0) END) AS b FROM e
), m AS (SELECT vec_id, min(f) AS f, min(b) AS b FROM a GROUP BY vec_id)
--
SELECT vec_id, CASE WHEN abs(f - b) >= 0.006 THEN CASE WHEN f <= b THEN 1 ELSE -1 END END AS direction
FROM m""",
)
def infer_direction(v: Views):
    rows = proj(v).withColumns({"anchor": F.lit(0.3), "predicted": F.lit(0.25)})
    return fusion.infer_direction(rows, ("vec_id",), "anchor", "predicted", 0.006)


SELECTION = PROJ + """, frames AS (
  SELECT vec_id, (vec_id % 20) / 20.0::DOUBLE AS predicted_s, 0.02 AS unc,
         CASE WHEN vec_id % 3 <> 0 THEN 0.19 END AS last_x, CASE WHEN vec_id % 3 <> 0 THEN 0.01 END AS last_y,
         0.03 AS moved, CASE WHEN vec_id % 11 = 0 THEN 0.5 ELSE 50.0 END AS speed FROM points
), c0 AS (
  SELECT p.*, f.unc, f.moved, f.speed, coalesce(sqrt((p.x - last_x) ** 2 + (p.y - last_y) ** 2), 0) AS shift,
         (s_visual - predicted_s) - floor(s_visual - predicted_s) AS t
  FROM proj p JOIN frames f USING (vec_id)
), c1 AS (
  SELECT *, abs(CASE WHEN t > 0.5 THEN t - 1 ELSE t END) AS err FROM c0
), c2 AS (
  SELECT *, 0.4 * err / (0.3 + unc) + 0.3 * distance / 0.05 + 0.3 * shift / 0.06 AS score
  FROM c1 WHERE distance <= 0.05 AND err <= 0.3 + unc AND NOT (speed <= 1 AND shift > 0.05)
), c3 AS (
  SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS second
  FROM c2 WINDOW w AS (PARTITION BY vec_id ORDER BY score, s_visual, y, x)
), best AS (SELECT * FROM c3 WHERE rn = 1),
have AS (SELECT DISTINCT vec_id FROM proj),
res AS (
  SELECT f.vec_id, unc AS u0, b.*, CASE WHEN s.vec_id IS NULL THEN 'visual_missing'
         WHEN b.score IS NULL THEN 'visual_out_of_gate' WHEN second - b.score < 0.15
         THEN 'visual_ambiguous' ELSE 'visual_selected' END AS reason
  FROM (SELECT vec_id, unc FROM frames) f LEFT JOIN have s USING (vec_id)
  LEFT JOIN (SELECT vec_id AS bid, s_visual, score, second FROM best) b ON b.bid = f.vec_id
)"""


@register(
    "select_projection",
    SELECTION + """
--
SELECT vec_id, CASE WHEN reason = 'visual_selected' THEN s_visual END AS s_visual,
       CASE WHEN reason = 'visual_selected' THEN score END AS score,
       least(1.0, u0 + CASE WHEN reason = 'visual_selected' THEN score * 0.01 ELSE 0 END) AS uncertainty,
       CASE WHEN reason = 'visual_selected' THEN 'observed' ELSE 'missing' END AS source, reason
FROM res""",
    "s_visual score uncertainty",
)
def select_projection(v: Views):
    i = F.col("vec_id")
    frames = v.table("embeddings").select(
        "vec_id", ((i % 20) / 20.0).alias("predicted_s"), F.lit(0.02).alias("current_uncertainty"),
        F.when(i % 3 != 0, 0.19).alias("last_x"), F.when(i % 3 != 0, 0.01).alias("last_y"),
        F.lit(0.03).alias("previous_displacement"),
        F.when(i % 11 == 0, 0.5).otherwise(50.0).alias("speed"), F.lit(1.0).alias("delta_time"),
    )
    rows = fusion.select_projection(
        frames, proj(v), ("vec_id",), diagonal=1.0, max_distance_fraction=0.05,
        max_progress_error=0.3, min_score_margin=0.15,
    )
    return rows.select("vec_id", "s_visual", "score", "uncertainty", "source", "reason")


# --- fusion ---------------------------------------------------------------------------

FUSION = fusion.FusionSettings(visual_gain=0.35, short_visual_gap=24.0, unavailable_uncertainty=0.05)

FUSE_IN = """, fin AS (
  SELECT o.session_id, o.frame, o.time_s, o.distance_m, o.delta_distance_m AS dd,
         o.odometry_uncertainty AS ou, o.odometry_source AS os, b.frame IS NOT NULL AS bd,
         CASE WHEN o.event_id % 3 = 0 THEN o.s END AS vis,
         row_number() OVER (PARTITION BY o.session_id ORDER BY o.frame) AS i
  FROM odo o LEFT JOIN boundaries b ON o.session_id = b.session_id AND o.frame = b.frame
)"""


def fuse_input(v: Views):
    marks = v.boundaries.select("session_id", "frame", F.lit(True).alias("is_boundary"))
    rows = odo(v).join(marks, ["session_id", "frame"], "left")
    visual = F.col("event_id") % 3 == 0
    return rows.withColumns(
        {
            "is_boundary": F.coalesce("is_boundary", F.lit(False)),
            "anchor_kind": F.lit("missing"),
            "anchor_uncertainty": F.lit(0.01),
            "s_visual": F.when(visual, F.col("s")),
            "visual_uncertainty": F.lit(0.01),
            "visual_reasons": F.array(F.when(visual, "visual_selected").otherwise("visual_missing")),
            "length": F.lit(LENGTH),
        }
    ).select("session_id", *fusion.FUSE_INPUT)


@register(
    "fuse_progress",
    (BOUNDARIES + ODO + FUSE_IN).replace("WITH sig0", "WITH RECURSIVE sig0") + """, walk AS (
  SELECT session_id, frame, i, FALSE AS anchored, 0.0::DOUBLE AS s, time_s AS t, NULL::DOUBLE AS vt,
         ou AS u, 0.0::DOUBLE AS d0, 0.0::DOUBLE AS u0, 'missing' AS source, NULL::DOUBLE AS so
  FROM fin WHERE i = 1
  UNION ALL
  SELECT session_id, frame, i, anchored OR bd,
         CASE WHEN bd THEN 0.0 WHEN NOT anchored THEN s WHEN vis IS NULL THEN pr
              ELSE least(1.0, greatest(0.0, pr + 0.35 * corr)) END,
         time_s, CASE WHEN bd OR (anchored AND vis IS NOT NULL) THEN time_s ELSE vt END,
         CASE WHEN bd THEN 0.01 WHEN NOT anchored THEN greatest(u, ou)
              ELSE least(1.0, CASE WHEN vis IS NOT NULL THEN 0.65 * base + 0.35 * 0.01
                   WHEN os = 'missing' OR time_s - vt > 24 THEN greatest(grow, 0.05) ELSE grow END) END,
         CASE WHEN bd THEN distance_m ELSE d0 END, CASE WHEN bd THEN ou ELSE u0 END,
         CASE WHEN bd THEN 'observed' WHEN NOT anchored THEN 'missing' WHEN vis IS NOT NULL THEN 'fused'
              WHEN os = 'interpolated' THEN 'interpolated' WHEN os = 'missing' THEN 'missing'
              ELSE 'predicted' END,
         CASE WHEN bd THEN 0.0 WHEN anchored
              THEN least(1.0, greatest(0.0, distance_m - d0) / 3000.0::DOUBLE) END
  FROM (SELECT *, least(1.0, base + greatest(0.0, time_s - t) * 0.05 / 24) AS grow,
               CASE WHEN vis - pr - floor(vis - pr) > 0.5 THEN vis - pr - floor(vis - pr) - 1
                    ELSE vis - pr - floor(vis - pr) END AS corr
        FROM (SELECT f.*, w.anchored, w.s, w.t, w.vt, w.u, w.d0, w.u0,
                     least(1.0, greatest(0.0, w.s + coalesce(f.dd, 0) / 3000.0::DOUBLE)) AS pr,
                     greatest(w.u, greatest(0.0, f.ou - w.u0)) AS base
              FROM walk w JOIN fin f ON f.session_id = w.session_id AND f.i = w.i + 1))
)
--
SELECT session_id, frame, CASE WHEN anchored AND (u < 0.05 OR so = 0 AND s = 0 AND vt = t AND u = 0.01)
       THEN s END AS s_fused, so AS s_odometry, least(1.0, u) AS s_uncertainty,
       CASE WHEN anchored AND u >= 0.05 THEN 'missing' ELSE source END AS s_source, anchored
FROM walk""",
    "s_fused s_odometry s_uncertainty",
)
def fuse_progress(v: Views):
    rows = fusion.fuse_progress(fuse_input(v), v.axis, FUSION)
    return rows.select(
        "session_id", "frame", "s_fused", "s_odometry", "s_uncertainty", "s_source", "anchored"
    )


NEAREST = BOUNDARIES + ODO + """, fr AS (
  SELECT o.session_id, o.frame, o.time_s, o.distance_m, o.event_id % 4 = 0 AS usable,
         b.frame IS NOT NULL AS bd
  FROM odo o LEFT JOIN boundaries b ON o.session_id = b.session_id AND o.frame = b.frame
), nb AS (
  SELECT *, last_value(CASE WHEN usable OR bd THEN frame END IGNORE NULLS) OVER p AS bf,
         first_value(CASE WHEN usable OR bd THEN frame END IGNORE NULLS) OVER n AS af
  FROM fr WINDOW p AS (PARTITION BY session_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                 n AS (PARTITION BY session_id ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
)"""


def anchor_frames(v: Views):
    marks = v.boundaries.select("session_id", "frame", F.lit(True).alias("bd"))
    return odo(v).join(marks, ["session_id", "frame"], "left").select(
        "session_id", "frame", "event_id", "time_s", "distance_m",
        (F.col("event_id") % 4 == 0).alias("usable"), F.coalesce("bd", F.lit(False)).alias("bd"),
        F.lit(LENGTH).alias("length"),
    )


@register(
    "nearest_gated",
    NEAREST + """
--
SELECT nb.session_id, nb.frame,
       CASE WHEN NOT x.bd AND abs(x.time_s - nb.time_s) <= 72
            AND abs(x.distance_m - nb.distance_m) / 3000 <= 0.5 THEN x.frame END AS before_frame,
       CASE WHEN NOT y.bd AND abs(y.time_s - nb.time_s) <= 72
            AND abs(y.distance_m - nb.distance_m) / 3000 <= 0.5 THEN y.frame END AS after_frame
FROM nb LEFT JOIN fr x ON x.session_id = nb.session_id AND x.frame = nb.bf
LEFT JOIN fr y ON y.session_id = nb.session_id AND y.frame = nb.af
WHERE nb.bd""",
)
def nearest_gated(v: Views):
    rows = joins.nearest_gated(
        anchor_frames(v), v.axis, usable="usable", boundary="bd", length="length",
        max_gap=72.0, max_distance_fraction=0.5,
    )
    return rows.select(
        "session_id", "frame", F.col("before.frame").alias("before_frame"),
        F.col("after.frame").alias("after_frame"),
    )


ANCHORS = fusion.AnchorSettings(
    max_bracketing_gap=72.0,
    max_bracketing_distance_fraction=0.5,
    max_one_sided_gap=36.0,
    max_one_sided_distance_fraction=0.25,
    max_distance=MAX_DISTANCE,
    max_progress_error=0.5,
    min_score_margin=0.01,
)


def ring_points(v: Views):
    """One point near the ring for most samples, its place taken from the lap position."""
    e = F.col("event_id")
    turn = F.col("s") * (2 * 3.141592653589793)
    radius = RADIUS + ((e % 7) - 3) / F.lit(100.0)
    return v.laps.filter(e % 3 != 0).select(
        "session_id", "frame", F.lit(0).alias("track_id"), (F.cos(turn) * radius).alias("x"),
        (F.sin(turn) * radius).alias("y"),
    )


def _projection_lists(v: Views):
    rows = geometry.project_points(ring_points(v), ring(v), MAX_DISTANCE, ("session_id", "frame"))
    item = F.struct(F.col("s_visual").alias("s"), F.col("distance").alias("d"), "x", "y")
    return rows.groupBy("session_id", "frame").agg(
        F.array_sort(F.collect_list(item)).alias("projections")
    )


@register("recover_anchor")
def recover_anchor(v: Views):
    """No SQL twin: nested choices over projection lists; a test walks through every case."""
    lists = _projection_lists(v)
    rows = anchor_frames(v).drop("usable").join(lists, ["session_id", "frame"], "left")
    rows = rows.withColumn("usable", F.col("projections").isNotNull())
    sides = joins.nearest_gated(
        rows, v.axis, usable="usable", boundary="bd", length="length", max_gap=72.0,
        max_distance_fraction=0.5,
    )
    for side in ("before", "after"):
        own = lists.select("session_id", F.col("frame").alias("_f"), F.col("projections").alias("_p"))
        sides = sides.withColumn("_f", F.col(f"{side}.frame")).join(own, ["session_id", "_f"], "left")
        found = F.struct(
            F.col(f"{side}.time_s"), F.col(f"{side}.distance_m"), F.col("_p").alias("projections")
        )
        sides = sides.withColumn(side, F.when(F.col(side).isNotNull(), found)).drop("_f", "_p")
    empty = F.array().cast("array<struct<s:double,d:double,x:double,y:double>>")
    sides = sides.select(
        "session_id", "frame", "time_s", "distance_m", "length",
        F.lit(None).cast("double").alias("last_raw_s"),
        F.when(F.col("event_id") % 2 == 0, empty).otherwise(F.col("projections")).alias("projections"),
        "before", "after",
    )
    return fusion.recover_anchors(sides, KEY, ANCHORS)


CHOSEN = (0, 1, 3)


@register(
    "compare_chosen_laps",
    DELTA + f"""
--
SELECT session_id, lap_a, lap_b, position, delta_s, speed_a, speed_b FROM lap_pairs
WHERE lap_a IN {CHOSEN} AND lap_b IN {CHOSEN} AND lap_a < lap_b""",
    "position delta_s speed_a speed_b",
)
def compare_chosen_laps(v: Views):
    """All pairs of three chosen laps; no other lap is resampled."""
    laps = marked_laps(v)
    rows = jobs.compare_laps_by_position(
        laps, v.axis, joins.chosen_pairs(v.laps, KEY, list(CHOSEN)), step=GRID_STEP,
        max_position_gap=POSITION_GAP, max_time_gap=TIME_GAP, channels=CHANNELS, chosen=True,
        start_times=align.confirmed_starts(laps, KEY, "s_reasons"),
    )
    return rows.select("session_id", "lap_a", "lap_b", "position", "delta_s", "speed_a", "speed_b")


@register("progress_job")
def progress_job(v: Views):
    """No SQL twin: the chain of choices is recursive over lists of projections.

    Labels are confirmed and the length is calibrated first, then vision and odometry are fused.
    """
    return jobs.diagnosed_progress(
        v.sig, ring_points(v), ring(v), v.axis, label="raw_lap", count=LABEL_COUNT, speed="value", quality="q",
        max_gap=FILL_GAP, max_missing=0.8, max_deviation=0.4, max_distance=MAX_DISTANCE,
        fusion_settings=FUSION,
        selection=fusion.SelectionSettings(
            diagonal=1.0, max_distance_fraction=0.05, max_progress_error=0.3, min_score_margin=0.05
        ),
        anchors=ANCHORS,
        default_length=v.sessions.select("session_id", F.lit(LENGTH).alias("length")),
    )["progress"]


