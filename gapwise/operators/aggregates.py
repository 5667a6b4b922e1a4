"""Summaries.  All are partial aggregates, so a hot key is combined before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapwise.channel import Channel, finite
from gapwise.schema import PROGRESS_SOURCES
from gapwise.ordered import Axis, Lag, overlap_join, plan_axis, quantiles, scan


def _span(order: str = "frame") -> Column:
    return F.max_by("time_s", order) - F.min_by("time_s", order)


def session_summary(
    df: DataFrame, keys: tuple[str, ...], position: str = "s", indicators: tuple[str, ...] = ("tc", "abs")
) -> DataFrame:
    """Duration, means, maxima and indicator shares of a session.

    Speeds default to 0.0 when there is none (a legacy rule); indicators that were never
    observed stay null.
    """
    return df.groupBy(*keys).agg(
        _span().alias("duration"),
        F.count(F.lit(1)).alias("total_frames"),
        F.avg("throttle").alias("avg_throttle"),
        F.max("throttle").alias("max_throttle"),
        F.avg("brake").alias("avg_brake"),
        F.max("brake").alias("max_brake"),
        F.avg(F.abs("steering")).alias("avg_steering_abs"),
        F.min("steering").alias("max_steering_left"),
        F.max("steering").alias("max_steering_right"),
        F.coalesce(F.avg("speed"), F.lit(0.0)).alias("avg_speed"),
        F.coalesce(F.max("speed"), F.lit(0.0)).alias("max_speed"),
        *(F.sum(i).cast("long").alias(f"{i}_frames") for i in indicators),
        *((F.avg(i) * 100).alias(f"{i}_percentage") for i in indicators),
        F.min(position).alias("min_position"),
        F.max(position).alias("max_position"),
        F.max(F.col(position).isNotNull()).alias("position_tracked"),
        F.count_distinct("lap_number").alias("total_laps"),
    )


def lap_summary(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    laps = df.filter(F.col("lap_number").isNotNull())
    return laps.groupBy(*keys, "lap_number").agg(
        _span().alias("duration"),
        F.count(F.lit(1)).alias("frames"),
        F.avg("throttle").alias("avg_throttle"),
        F.avg("brake").alias("avg_brake"),
        F.max("throttle").alias("max_throttle"),
        F.max("brake").alias("max_brake"),
        F.avg(F.abs("steering")).alias("avg_steering_abs"),
        F.avg("speed").alias("avg_speed"),
        F.max("speed").alias("max_speed"),
    )


def coverage(df: DataFrame, keys: tuple[str, ...], channels: list[Channel]) -> DataFrame:
    """Non-null and fresh counts per field beside the number of rows."""
    counts = [F.count(F.lit(1)).alias("frames")]
    for c in channels:
        counts.append(F.count_if(c.v().isNotNull()).alias(f"{c.field}_present"))
        counts.append(F.count_if(c.fresh()).alias(f"{c.field}_fresh"))
    return df.groupBy(*keys).agg(*counts)


def non_finite_points(points: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    truth_bad = ~finite(F.col("truth"))
    prediction_bad = F.col("prediction").isNotNull() & ~finite(F.col("prediction"))
    rule = F.when(truth_bad, "nonfinite_truth").when(prediction_bad, "nonfinite_prediction")
    rows = points.withColumn("rule", rule).filter(F.col("rule").isNotNull())
    return rows.select(*keys, "rule", F.col("frame").cast("string").alias("key"))


def field_errors(points: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Coverage, mean and 95th percentile of absolute errors; abstentions are not errors."""
    error = F.abs(F.col("truth") - F.col("prediction"))
    rows = points.withColumn("_e", error)
    base = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("denominator"),
        F.count("_e").alias("measured_count"),
        F.avg("_e").alias("mae"),
    )
    high = quantiles(rows, keys, "_e", {"p95": 0.95})
    joined = base.join(high, list(keys), "left")
    return joined.withColumns(
        {
            "abstentions": F.col("denominator") - F.col("measured_count"),
            "coverage": F.col("measured_count") / F.col("denominator"),
            "status": F.when(F.col("measured_count") > 0, "available").otherwise("not_evaluated"),
        }
    )


def point_metrics(points: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    error = F.abs(F.col("prediction") - F.col("truth"))
    return points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("annotated_points"),
        F.count(error).alias("available"),
        F.avg(error).alias("mae"),
        F.max(error).alias("max_error"),
    )


def circular_range(df: DataFrame, keys: tuple[str, ...], position: str) -> DataFrame:
    """Shortest arc that covers all positions of a key; needs two of them.

    Positions are counted apart first: equal positions leave no gap between them.
    """
    turn = F.pmod(F.col(position), F.lit(1.0))
    points = df.select(*keys, turn.alias("_s")).filter(F.col("_s").isNotNull())
    counted = points.groupBy(*keys, "_s").count()
    axis = plan_axis(counted, keys, ("_s",))
    gaps = scan(counted, axis, _p=Lag(F.col("_s")))
    out = gaps.groupBy(*keys).agg(
        F.sum("count").alias("measured_count"),
        F.min("_s").alias("_lo"),
        F.max("_s").alias("_hi"),
        F.max(F.col("_s") - F.col("_p")).alias("_gap"),
    )
    wrap = F.col("_lo") + 1 - F.col("_hi")
    widest = F.greatest(F.coalesce(F.col("_gap"), F.lit(0.0)), wrap)
    enough = F.col("measured_count") >= 2
    return out.withColumns(
        {
            "range_s": F.when(enough, 1 - widest),
            "status": F.when(enough, "available").otherwise("not_evaluated"),
        }
    ).drop("_lo", "_hi", "_gap")


READINESS = dict(
    min_sources=2, min_passages_per_source=2, min_readable=100, min_degraded=20, min_events=20
)


def corpus_violations(entries: DataFrame) -> DataFrame:
    """Sources that occur more than once, and unknown roles."""
    repeated = entries.groupBy("source").count().filter("count > 1")
    roles = entries.filter(~F.col("role").isin("development", "holdout"))
    return repeated.select(
        F.lit("repeated_source").alias("rule"), F.col("source").alias("key")
    ).unionByName(roles.select(F.lit("invalid_role").alias("rule"), F.col("source").alias("key")))


def corpus_readiness(entries: DataFrame, limits: dict | None = None) -> DataFrame:
    """Named checks over all sources, in long form, with the overall status.

    ``entries``: ``source, role, recording_id, status, readable, degraded, events, passages``;
    ``readable`` is the least readable field.
    """
    lim = {**READINESS, **(limits or {})}
    named = F.coalesce(F.trim("recording_id") != "", F.lit(False))
    total = entries.agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and(named).alias("named"),
        F.coalesce(F.min("passages"), F.lit(0)).alias("passages"),
        F.count_distinct("role").alias("roles"),
        F.coalesce(F.sum("readable"), F.lit(0)).alias("readable"),
        F.coalesce(F.sum("degraded"), F.lit(0)).alias("degraded"),
        F.coalesce(F.sum("events"), F.lit(0)).alias("events"),
        F.bool_and(F.coalesce(F.col("status") == "pass", F.lit(False))).alias("reviewed"),
    )
    some = F.col("n") > 0
    checks = {
        "sources": F.col("n") >= lim["min_sources"],
        "recording_lineage": F.coalesce("named", F.lit(True)),
        "repeated_passages": some & (F.col("passages") >= lim["min_passages_per_source"]),
        "roles": F.col("roles") == 2,
        "readable": F.col("readable") >= lim["min_readable"],
        "degraded": F.col("degraded") >= lim["min_degraded"],
        "events": F.col("events") >= lim["min_events"],
        "reviewed": some & F.coalesce("reviewed", F.lit(False)),
    }
    every = None
    for passed in checks.values():
        every = passed if every is None else every & passed
    pairs = F.array(
        *[F.struct(F.lit(n).alias("check"), c.alias("passed")) for n, c in checks.items()]
    )
    status = F.when(every, "pass").otherwise("not_evaluated")
    return total.withColumn("status", status).select("status", F.inline(pairs))


CHECKS = (
    "software_regressions", "lap_events", "field_accuracy", "field_coverage", "timebase",
    "holdout",
)


def combine_status(status: Column) -> Column:
    """Aggregate: any fail fails; all pass and not empty passes; else not evaluated."""
    failed = F.coalesce(F.bool_or(status == "fail"), F.lit(False))
    passed = F.coalesce(F.bool_and(F.coalesce(status == "pass", F.lit(False))), F.lit(False))
    return F.when(failed, "fail").when(passed, "pass").otherwise("not_evaluated")


def gate_violations(checks: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    allowed = ("pass", "fail", "not_evaluated")
    rule = (
        F.when(~F.col("check").isin(*CHECKS), "unknown_check")
        .when(~F.col("status").isin(*allowed), "invalid_status")
        .when((F.col("status") == "pass") & ~F.col("has_evidence"), "pass_without_evidence")
    )
    rows = checks.withColumn("rule", rule).filter(F.col("rule").isNotNull())
    return rows.select(*keys, "rule", F.col("check").alias("key"))


def gate_report(checks: DataFrame, keys: tuple[str, ...], compatible: str) -> DataFrame:
    """Status of the six named checks per key; checks that were not reported count as open."""
    found = checks.groupBy(*keys).agg(
        combine_status(F.col("status")).alias("_some"),
        F.collect_set(F.when(F.col("check").isin(*CHECKS), F.col("check"))).alias("_have"),
        F.bool_and(F.col(compatible)).alias("_compatible"),
        F.count_if(F.col("status") == "fail").alias("failed_checks"),
    )
    # At most six names exist, so the set is small.
    full = F.size(F.array_intersect("_have", F.array(*[F.lit(c) for c in CHECKS]))) == len(CHECKS)
    status = (
        F.when(F.col("_some") == "fail", "fail")
        .when((F.col("_some") == "pass") & full & F.col("_compatible"), "pass")
        .otherwise("not_evaluated")
    )
    return found.select(
        *keys,
        status.alias("status"),
        (status == "pass").alias("eligible"),
        (F.lit(len(CHECKS)) - F.size("_have")).alias("missing_checks"),
        F.col("failed_checks"),
    )


def segment_coverage(
    frames: DataFrame, segments: DataFrame, keys: tuple[str, ...], *,
    span: tuple[str, str] = ("frame_lo", "frame_hi"), on: str = "frame",
    fresh: str = "fresh", minimum: float = 0.95, half_open: bool = False,
    capture: DataFrame | None = None,
) -> DataFrame:
    """Share of fresh frames among all frames of the segments, each frame counted once.

    A frame without a row is not fresh.  ``capture`` lists the frames (keys, ``on``) that the
    recording has; without it ``on`` counts frames and every number of a segment is one.  A
    session without segments, or without a frame in them, is not evaluated.
    """
    merged = _merged_spans(segments, keys, span, 0 if half_open or capture is not None else 1)

    def inside(rows: DataFrame, name: str) -> DataFrame:
        pairs = overlap_join(rows.distinct(), merged, keys, (on, on), ("_lo", "_hi"))
        if half_open:
            pairs = pairs.filter(F.col(f"l.{on}") < F.col("r._hi"))
        met = pairs.select("l.*").distinct()
        return met.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))

    if capture is None:
        length = F.col("_hi") - F.col("_lo") + 1
        whole = merged.groupBy(*keys).agg(F.sum(length).cast("long").alias("denominator_frames"))
    else:
        whole = inside(capture.select(*keys, on), "denominator_frames")
    seen = inside(frames.filter(F.col(fresh)).select(*keys, on), "observed_frames")
    sessions = (frames if capture is None else capture).select(*keys).union(segments.select(*keys)).distinct()
    out = sessions.join(whole, list(keys), "left").join(seen, list(keys), "left")
    out = out.na.fill(0, ["denominator_frames", "observed_frames"])
    ratio = F.when(F.col("denominator_frames") > 0, F.col("observed_frames") / F.col("denominator_frames"))
    status = F.when(ratio.isNull(), "not_evaluated").when(ratio >= minimum, "pass").otherwise("fail")
    return out.withColumns({"ratio": ratio, "status": status})


def _merged_spans(segments: DataFrame, keys: tuple[str, ...], span: tuple[str, str], step: int) -> DataFrame:
    """Spans (``_lo``, ``_hi``) of which none meets another; ``step`` joins neighbouring numbers."""
    low, high = span
    order = Window.partitionBy(*keys).orderBy(low, high)
    rows = segments.select(*keys, low, high).filter(F.col(low) <= F.col(high))
    reach = F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.coalesce(F.col(low) > reach + step, F.lit(True)).cast("int"))
    rows = rows.withColumn("_span", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_span").agg(F.min(low).alias("_lo"), F.max(high).alias("_hi")).drop("_span")


def source_counts(progress: DataFrame, keys: tuple[str, ...], source: str) -> DataFrame:
    rows = progress.filter(F.col(source).isNotNull() & (F.col(source) != ""))
    return rows.groupBy(*keys, source).agg(F.count(F.lit(1)).alias("n"))


def consistency_counters(progress: DataFrame, axis: Axis, **more: Column) -> DataFrame:
    """Counters of implausible progress: early completion, resets, jumps, unavailability.

    ``progress``: ``frame, time_s, s_fused, s_odometry, is_boundary``.  ``more`` are further
    aggregates of the same rows.
    """
    rows = scan(
        progress,
        axis,
        _p=Lag(F.struct(F.col("s_fused").alias("s"), F.col("time_s").alias("t"))),
    )
    s, so, quiet = F.col("s_fused"), F.col("s_odometry"), ~F.col("is_boundary")
    early = quiet & (s >= 0.999) & (so.isNull() | (so < 0.99))
    both = quiet & s.isNotNull() & F.col("_p.s").isNotNull()
    reset = both & (F.col("_p.s") >= 0.9) & (s <= 0.1)
    turn = F.abs(F.pmod(s - F.col("_p.s") + 0.5, F.lit(1.0)) - 0.5)
    lost = F.when(
        F.col("_p").isNotNull() & F.col("_p.s").isNull(),
        F.greatest(F.lit(0.0), F.col("time_s") - F.col("_p.t")),
    )
    return rows.groupBy(*axis.keys).agg(
        F.count(F.lit(1)).alias("frame_count"),
        F.count_if("is_boundary").alias("confirmed_boundary_count"),
        F.count_if(early).alias("premature_completion_count"),
        F.count_if(reset).alias("unconfirmed_reset_count"),
        F.count_if(both & (turn > 0.1)).alias("nonlocal_jump_count"),
        F.coalesce(F.sum(lost), F.lit(0.0)).alias("unavailable_duration_s"),
        *(column.alias(name) for name, column in more.items()),
    )


def diagnosis(progress: DataFrame, axis: Axis) -> DataFrame:
    """Consistency of progress, one row per key: counters, rows per source, boundaries per anchor, spread.

    ``progress``: as for ``consistency_counters``, and ``lap_number, s_source, anchor_kind``.  The
    domains of sources and anchors are closed, so all counts are one aggregate of one pass.
    """
    counts = {f"source_{n}": F.count_if(F.col("s_source") == n) for n in PROGRESS_SOURCES}
    counts |= {
        f"anchor_{n}": F.count_if(F.col("is_boundary") & (F.col("anchor_kind") == n))
        for n in ("exact", "interpolated", "nearest", "missing")
    }
    spread = checkpoint_spread(progress, axis)
    out = consistency_counters(progress, axis, **counts).join(spread, list(axis.keys), "left")
    return out.na.fill(0, ["comparable_checkpoint_count"])


def checkpoint_spread(progress: DataFrame, axis: Axis) -> DataFrame:
    """Largest difference of fused progress between laps at 99 odometry checkpoints."""
    keys = (*axis.keys, "lap_number")
    known = F.col("lap_number").isNotNull() & F.col("s_odometry").isNotNull()
    rows = progress.filter(known & F.col("s_fused").isNotNull())
    curve = rows.groupBy(*keys, "s_odometry").agg(F.avg("s_fused").alias("y"))
    ends = curve.groupBy(*keys).agg(F.min("s_odometry").alias("a"), F.max("s_odometry").alias("b"))
    whole = ends.filter((F.col("a") <= 0.01) & (F.col("b") >= 0.99)).select(*keys)
    along = Axis(keys, ("s_odometry",), 1.0 if axis.chunked else None)
    if axis.chunked:
        along = plan_axis(curve, keys, ("s_odometry",))
    steps = scan(curve, along, _p=Lag(F.struct(F.col("s_odometry").alias("x"), F.col("y"))))
    x, px = F.col("s_odometry"), F.col("_p.x")
    # Checkpoints in (previous, current]; the first row only answers for itself.
    first = F.when(px.isNull(), F.ceil(x * 100)).otherwise(F.floor(px * 100))
    ks = F.sequence(F.greatest(first - 1, F.lit(1)), F.greatest(F.ceil(x * 100) + 1, F.lit(1)))
    t = F.col("k") / 100.0
    inside = F.col("k").between(1, 99) & ((t == x) | ((t > px) & (t < x)))
    share = (t - px) / (x - px)
    at = F.when(t == x, F.col("y")).otherwise(F.col("_p.y") + share * (F.col("y") - F.col("_p.y")))
    values = steps.withColumn("k", F.explode(ks)).filter(inside).withColumn("_at", at)
    values = values.join(whole, list(keys), "left_semi")
    spreads = values.groupBy(*axis.keys, "k").agg(
        F.count(F.lit(1)).alias("n"), (F.max("_at") - F.min("_at")).alias("spread")
    )
    spreads = spreads.filter("n >= 2")
    return spreads.groupBy(*axis.keys).agg(
        F.max("spread").alias("max_checkpoint_spread"),
        F.count(F.lit(1)).alias("comparable_checkpoint_count"),
    )


def cell_frequency(
    cells: DataFrame, keys: tuple[str, ...], predicate: Column, threshold: float
) -> DataFrame:
    """Cells that satisfy the predicate in at least the given share of the frames."""
    hit = F.avg(F.coalesce(predicate, F.lit(False)).cast("double"))
    return cells.groupBy(*keys).agg(hit.alias("frequency")).filter(F.col("frequency") >= threshold)
