"""Composite jobs built from the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.channel import Channel, finite
from gapwise.operators import (
    align, aggregates, checks, episodes, fusion, geometry, joins, labels, odometry, runs, scoring,
)
from gapwise.operators.runs import EventSettings
from gapwise.ordered import (
    Axis, Sum, asof, exceeds_task, materialize, overlap_join, plan_axis, scan,
)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def lap_report(
    samples: DataFrame,
    laps: DataFrame,
    zones: DataFrame,
    axis: Axis,
    *,
    controls: list[Channel],
    steps: list[Channel],
    settings: EventSettings,
    frame_time: float,
) -> dict[str, DataFrame]:
    """Events with zones, missing intervals and fresh counts of bounded laps.

    ``laps``: keys, ``lap_number, start_frame, end_frame``.  All laps in one run; a lap
    is one more key, so events never cross a lap.
    """
    found = asof(samples, laps, axis, "frame", "start_frame", "_lap")
    inside = found.filter(F.col("frame") < F.col("_lap.end_frame"))
    rows = inside.withColumn("lap_number", F.col("_lap.lap_number")).drop("_lap")
    along = axis.within("lap_number")
    events = [runs.hysteresis_events(rows, along, controls, settings)] if controls else []
    events += [runs.change_events(rows, along, c, settings.max_gap) for c in steps]
    placed = joins.assign_zone(_union(events), zones, axis)
    every = [*controls, *steps]
    missing = [runs.missing_intervals(rows, along, c, frame_time) for c in every]
    return {
        "events": placed,
        "missing": _union(missing),
        "available": aggregates.coverage(rows, along.keys, every),
    }


def episode_job(
    samples: DataFrame,
    axis: Axis,
    first: Channel,
    second: Channel,
    settings: EventSettings,
    frame_time: float,
) -> dict[str, DataFrame]:
    """Events, episodes, gaps, resumptions and overlaps of two controls, and clock violations."""
    fields = [first, second]
    # Events and episodes of both fields come from the same pass; its few results are kept.
    marked = episodes.marked_episodes(samples, axis, fields, settings)
    both = materialize(episodes.episodes_of(marked, axis))
    found = [both.filter(F.col("field") == c.field) for c in fields]
    gaps = [runs.evidence_gaps(samples, axis, c, settings.max_gap, frame_time) for c in fields]
    return {
        "clock_violations": checks.check_clock(samples, axis, frame_time),
        "events": runs.events_of(marked, axis.within("field")),
        "episodes": both,
        "gaps": _union(gaps),
        "resumptions": episodes.resumptions(both, axis),
        "overlaps": episodes.overlap_intervals(found[0], found[1], axis.keys),
    }


def case_summary(
    passages: DataFrame, speed_reviews: DataFrame, samples: DataFrame, keys: tuple[str, ...],
    start_s: float = 0.0,
) -> dict[str, DataFrame]:
    """Duration bounds of reviewed passages, and speeds admitted by review.

    ``samples``: keys, ``frame, time_s, value, quality``.
    """
    times = samples.select(*keys, "frame", "time_s")
    rows = passages
    for mark in ("entry_lo", "entry_hi", "exit_lo", "exit_hi"):
        at = times.select(*keys, F.col("frame").alias(mark), F.col("time_s").alias(f"t_{mark}"))
        rows = rows.join(at, [*keys, mark], "left")
    durations = rows.select(
        *keys,
        "id",
        (F.col("t_exit_lo") - F.col("t_entry_hi")).alias("range_lo_s"),
        (F.col("t_exit_hi") - F.col("t_entry_lo")).alias("range_hi_s"),
    )
    read = samples.select(*keys, "frame", "time_s", "value", "quality")
    speeds = speed_reviews.join(read, [*keys, "frame"], "left")
    agrees = (F.col("quality") == "observed") & (F.col("value") == F.col("hud_kmh"))
    speeds = speeds.select(
        *speed_reviews.columns,
        F.col("value").alias("extracted"),
        F.when(agrees, F.col("value")).alias("admitted"),
        F.coalesce("quality", F.lit("missing")).alias("quality"),
        (F.col("time_s") + start_s).alias("source_time_s"),
    )
    return {"durations": durations, "speeds": speeds}


def field_status(
    errors: DataFrame, keys: tuple[str, ...], *, mae: float, p95: float | None, coverage: float
) -> DataFrame:
    """Accuracy and coverage status of ``field_errors`` rows."""
    good = F.col("mae") <= mae
    if p95 is not None:
        good = good & (F.col("p95") <= p95)
    accuracy = F.when(F.col("mae").isNull(), "not_evaluated").when(good, "pass")
    return errors.withColumns(
        {
            "accuracy_status": accuracy.otherwise("fail"),
            "coverage_status": F.when(F.col("denominator") == 0, "not_evaluated")
            .when(F.col("coverage") >= coverage, "pass")
            .otherwise("fail"),
        }
    )


def latency_status(max_error: float) -> Column:
    """Status of pedal events from match metrics and the observable truth count."""
    late = F.coalesce(F.col("p95_error_s") > max_error, F.lit(False))
    open_ = (F.col("truth_count") == 0) | (F.col("observable_count") < F.col("truth_count"))
    return (
        F.when(late, "fail")
        .when(open_, "not_evaluated")
        .when(F.col("missed_count") > 0, "fail")
        .otherwise("pass")
    )


def lap_event_status(max_error: float, complete_review: Column) -> Column:
    late = F.coalesce(F.col("p95_error_s") > max_error, F.lit(False))
    extra = F.col("duplicate_count") + F.col("outside_count")
    return (
        F.when(F.col("truth_count") == 0, "not_evaluated")
        .when((F.col("missed_count") > 0) | late, "fail")
        .when(~complete_review, "not_evaluated")
        .when(extra > 0, "fail")
        .otherwise("pass")
    )


def observable_truth(
    truth: DataFrame, frames: DataFrame, keys: tuple[str, ...], window: float,
    capture: DataFrame | None = None,
) -> DataFrame:
    """Truth events around which every frame within the window has a fresh reading.

    ``frames``: keys, ``time_s, fresh``.  ``capture`` (keys, ``time_s``) lists the frames that
    the recording has; one without a row in ``frames`` is not fresh.
    """
    read = frames.select(*keys, "time_s", "fresh")
    marked = read.select(*keys).unionByName(truth.select(*keys)).unionByName(truth.select(*keys))
    if capture is not None:
        marked = marked.unionByName(capture.select(*keys))
        listed = capture.select(*keys, "time_s").distinct().withColumn("fresh", F.lit(False))
        read = read.unionByName(listed).groupBy(*keys, "time_s").agg(F.bool_or("fresh").alias("fresh"))
    # Running counts at both ends of a window say what is inside; no frame meets an event.
    mid = (F.col("lo_s") + F.col("hi_s")) / 2
    ends = F.array(
        F.struct((mid - window).alias("_t"), F.lit(0).alias("_side")),
        F.struct((mid + window).alias("_t"), F.lit(2).alias("_side")),
    )
    marks = truth.select(*keys, "id", F.inline(ends))
    rows = read.select(*keys, F.col("time_s").alias("_t"), F.lit(1).alias("_side"), F.col("fresh").cast("long").alias("_f"))
    both = marks.unionByName(rows, allowMissingColumns=True)
    frame = F.when(F.col("_side") == 1, F.lit(1).cast("long"))
    # The rows as given are no fewer than the grouped ones, and cheaper to count.
    order = ("_t", "_side")
    along = plan_axis(both, keys, order) if exceeds_task(marked, keys) else Axis(keys, order)
    counted = scan(both, along, _n=Sum(frame), _m=Sum(F.col("_f")))
    sign = F.when(F.col("_side") == 0, -1).otherwise(1)
    counts = counted.filter("_side <> 1").groupBy(*keys, "id").agg(
        F.sum(sign * F.coalesce("_n", F.lit(0))).alias("n"), F.sum(sign * F.coalesce("_m", F.lit(0))).alias("m")
    )
    return counts.filter("n >= 2 AND n = m").select(*keys, "id")


def evaluate_events(
    truth: DataFrame, predictions: DataFrame, frames: DataFrame, axis: Axis, *,
    window: float, max_error: float, capture: DataFrame | None = None,
) -> DataFrame:
    """Match one kind of reviewed events with crossings near them, and judge the latency.

    Crossings away from every truth event are outside the review, not false.
    """
    keys = axis.keys
    nobody = truth.select(*keys, F.col("id").alias("truth_id"), F.lit(None).cast(
        predictions.schema["id"].dataType).alias("prediction_id")).limit(0)
    near = scoring.match_classes(truth, predictions, nobody, axis, window)
    near = near.filter((F.col("side") == "prediction") & (F.col("class") == "duplicate"))
    inside = predictions.join(near.select(*keys, "id"), [*keys, "id"], "left_semi")
    matches = materialize(scoring.match_events(truth, inside, axis, window))
    classes = scoring.match_classes(truth, inside, matches, axis, window)
    metrics = scoring.match_metrics(classes, matches, keys)
    seen = observable_truth(truth, frames, keys, window, capture)
    counts = seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("observable_count"))
    out = metrics.join(counts, list(keys), "left").na.fill(0, ["observable_count"])
    return out.withColumn("latency_status", latency_status(max_error))


def evaluate_laps(
    truth: DataFrame, transitions: DataFrame, axis: Axis, *, window: float, max_error: float,
    complete_review: Column,
) -> DataFrame:
    """Match reviewed lap boundaries with confirmed ones by their first candidate time."""
    keys = axis.keys
    predictions = transitions.filter(F.col("first_candidate_time_s").isNotNull()).select(
        *keys, F.col("frame").alias("id"), F.col("first_candidate_time_s").alias("time_s"),
        "confirmed_at_s",
    )
    matches = materialize(scoring.match_events(truth, predictions, axis, window))
    classes = scoring.match_classes(truth, predictions, matches, axis, window)
    metrics = scoring.match_metrics(classes, matches, keys)
    return metrics.withColumn("gate_status", lap_event_status(max_error, complete_review))


def false_observed(
    frames: DataFrame, samples: DataFrame, keys: tuple[str, ...], field: str
) -> DataFrame:
    """Reviewed frames that hide a field although its reading is fresh.

    ``frames``: keys, ``frame, visibility``; ``samples``: keys, ``frame, fresh``.
    """
    hidden = frames.filter(~F.col("visibility")[field]).select(*keys, "frame").distinct()
    fresh = samples.filter("fresh").select(*keys, "frame")
    return hidden.join(fresh, [*keys, "frame"], "left_semi")


def landmark_positions(
    landmarks: DataFrame, samples: DataFrame, keys: tuple[str, ...]
) -> DataFrame:
    """Dispersion of progress at repeated passages of a landmark.

    ``landmarks``: keys, ``landmark_id, id, frame_lo, frame_hi``; ``samples``: keys,
    ``frame, s, s_quality``; the frame in the middle is read, unusable flags give null.
    """
    mid = F.floor((F.col("frame_lo") + F.col("frame_hi")) / 2).cast("long")
    usable = ~F.col("s_quality").isin("missing", "held", "anomalous")
    read = samples.select(*keys, "frame", F.when(usable, F.col("s")).alias("s"))
    rows = landmarks.withColumn("frame", mid).join(read, [*keys, "frame"], "left")
    by = (*keys, "landmark_id")
    ranges = aggregates.circular_range(rows, by, "s")
    total = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("denominator"))
    out = total.join(ranges, list(by), "left").na.fill(0, ["measured_count"])
    return out.withColumn("status", F.coalesce("status", F.lit("not_evaluated")))


def compare_annotations(
    events: DataFrame, episode_rows: DataFrame, points: DataFrame, passages: DataFrame,
    segments: DataFrame, visibility: DataFrame, keys: tuple[str, ...], frame_time: float,
) -> dict[str, DataFrame]:
    """Reviewed points, passages and visible spans beside the episodes they concern.

    ``points``: keys, ``frame, field, truth, prediction``; ``visibility``: keys, ``field,
    start_s, end_s``.
    """
    metrics = aggregates.point_metrics(points, (*keys, "field"))
    comparisons = joins.unique_event_in_window(passages, segments, events, keys, frame_time)
    by = (*keys, "field")
    inside = overlap_join(
        episode_rows, points, by, ("start_frame", "end_frame"), ("frame", "frame")
    )
    numeric = inside.groupBy(
        *[F.col(f"l.{k}").alias(k) for k in keys], F.col("l.id").alias("id")
    ).agg(F.count(F.lit(1)).alias("numeric_frames"))
    seen = overlap_join(
        episode_rows, visibility, by, ("start_time_s", "end_time_s"), ("start_s", "end_s")
    )
    start = F.greatest(F.col("l.start_time_s"), F.col("r.start_s"))
    end = F.least(F.col("l.end_time_s"), F.col("r.end_s"))
    intersections = seen.filter(start < end).select(
        *[F.col(f"l.{k}").alias(k) for k in keys],
        F.col("l.id").alias("id"),
        start.alias("start_time_s"),
        end.alias("end_time_s"),
    )
    return {
        "point_metrics": metrics,
        "event_comparisons": comparisons,
        "numeric_frames": numeric,
        "visibility_intersections": intersections,
    }


def progress_job(
    samples: DataFrame,
    bounds: DataFrame,
    points: DataFrame | None,
    ring: DataFrame | None,
    axis: Axis,
    *,
    speed: str,
    quality: str,
    max_gap: float,
    max_missing: float,
    max_deviation: float,
    max_distance: float,
    fusion_settings: fusion.FusionSettings,
    selection: fusion.SelectionSettings,
    anchors: fusion.AnchorSettings,
    default_length: DataFrame | None = None,
) -> DataFrame:
    """Integrate, calibrate, project, recover anchors and fuse, one row per sample.

    ``points``: keys, ``frame, track_id, x, y``; several points may share a frame, and without
    them odometry alone tells the progress.
    """
    keys = axis.keys
    # Each of the three kept tables is read several times below.
    odo = materialize(odometry.integrate(samples, axis, speed=speed, quality=quality, max_gap=max_gap))
    laps = odometry.lap_distances(odo, bounds, axis)
    judged = odometry.judge_laps(laps, keys, max_missing=max_missing, max_deviation=max_deviation)
    length = odometry.calibrate_length(judged, keys, max_deviation=max_deviation)
    length = length.select(*keys, F.col("effective_length_m").alias("length"))
    if default_length is not None:
        fallback = default_length.withColumnRenamed("length", "_fallback")
        length = fallback.join(length, list(keys), "left").select(
            *keys, F.coalesce("length", "_fallback").alias("length")
        )
    if points is None:
        nothing = F.lit(None).cast("array<struct<s:double,d:double,x:double,y:double>>")
        per_frame = odo.select(*keys, "frame", nothing.alias("projections")).limit(0)
    else:
        per_frame = materialize(_frame_projections(points, ring, max_distance, keys))
    marks = bounds.select(*keys, "frame", F.lit(True).alias("is_boundary"))
    rows = odo.select(
        *keys, "frame", "time_s", F.col(speed).cast("double").alias("speed"), "distance_m",
        "delta_distance_m", "odometry_uncertainty", "odometry_source",
    )
    rows = rows.join(per_frame, [*keys, "frame"], "left").join(marks, [*keys, "frame"], "left")
    rows = rows.join(length, list(keys), "left").withColumn(
        "is_boundary", F.coalesce("is_boundary", F.lit(False))
    )
    rows = materialize(rows.withColumn("_usable", F.col("projections").isNotNull()))
    sides = joins.nearest_gated(
        rows, axis, usable="_usable", boundary="is_boundary", length="length",
        max_gap=anchors.max_bracketing_gap,
        max_distance_fraction=anchors.max_bracketing_distance_fraction,
    ).select(*keys, "frame", "before", "after")
    for side in ("before", "after"):
        own = per_frame.select(*keys, F.col("frame").alias("_f"), F.col("projections").alias("_pr"))
        sides = sides.withColumn("_f", F.col(f"{side}.frame")).join(own, [*keys, "_f"], "left")
        found = F.struct(
            F.col(f"{side}.time_s"), F.col(f"{side}.distance_m"), F.col("_pr").alias("projections")
        )
        sides = sides.withColumn(side, F.when(F.col(side).isNotNull(), found)).drop("_f", "_pr")
    rows = rows.join(sides, [*keys, "frame"], "left").drop("_usable")
    return fusion.track_progress(rows, axis, fusion_settings, selection, anchors)


def _frame_projections(points: DataFrame, ring: DataFrame, reach: float, keys: tuple[str, ...]) -> DataFrame:
    """``projections`` of every frame that has any; they are bounded by the segments near its points."""
    item = F.struct(
        F.col("s_visual").alias("s"), F.col("distance").alias("d"), F.col("x"), F.col("y")
    )
    projected = geometry.project_points(points, ring, reach, (*keys, "frame"))
    return projected.groupBy(*keys, "frame").agg(
        F.array_sort(F.collect_list(item)).alias("projections")
    )


def diagnosed_progress(
    samples: DataFrame, points: DataFrame | None, ring: DataFrame | None, axis: Axis, *,
    label: str, count: int, **settings,
) -> dict[str, DataFrame]:
    """The whole way from label readings to progress and its diagnosis.

    First pass: labels are confirmed after ``count`` equal readings, and their boundaries
    calibrate the length as aggregates.  Second pass: ``progress_job`` with that length.
    The diagnosis is one row per session.
    """
    keys = axis.keys
    # One confirmed row per sample, used for the boundaries and for the lap of every row.
    states = materialize(labels.confirm_labels(samples, axis, label, count))
    bounds = labels.boundaries(states, axis)
    told = progress_job(states, bounds, points, ring, axis, **settings)
    lap = states.select(*keys, "frame", "time_s", F.col("confirmed_label").alias("lap_number"), "is_boundary")
    progress = materialize(lap.join(told, [*keys, "frame"]))
    return {
        "boundaries": bounds,
        "progress": progress,
        "diagnosis": aggregates.diagnosis(progress, axis),
    }


def compare_laps_by_position(
    laps: DataFrame, axis: Axis, pairs: DataFrame, *, step: float, max_position_gap: float,
    max_time_gap: float, channels: dict, start_times: DataFrame | None = None, chosen: bool = False,
) -> DataFrame:
    """Channels and time lost for pairs of laps on one position grid.

    With ``chosen`` the pairs name few of the laps, and only those are resampled.
    """
    if chosen:
        sides = [pairs.select(*axis.keys, F.col(c).alias("lap_number")) for c in ("lap_a", "lap_b")]
        laps = laps.join(sides[0].unionByName(sides[1]).distinct(), [*axis.keys, "lap_number"], "left_semi")
    wide = align.resample_wide(
        laps, axis, step=step, max_position_gap=max_position_gap, max_time_gap=max_time_gap,
        channels=channels, start_times=start_times,
    )
    return joins.time_deltas(wide, pairs, axis.keys)


def is_fresh(value: str, quality: str) -> Column:
    return F.coalesce((F.col(quality) == "observed") & finite(F.col(value)), F.lit(False))
